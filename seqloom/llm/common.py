"""Small helpers of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Bytes of text that are split into words at a time.
BLOCK_BYTES = 1 << 20


def read(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def plain(docs: DataFrame) -> DataFrame:
    """Without columns whose name starts with two underscores, which operators use themselves."""
    return docs.select(*(f"`{c}`" for c in docs.columns if not c.startswith("__")))


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 bytes of each text, one at a time; null is empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def word_blocks(data: bytes, size: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Words between ASCII white space, in lists of bounded size for texts of any length."""
    start, end = 0, len(data)
    while end - start > size:
        cut = start + size
        while cut < end and data[cut] not in b" \t\n\v\f\r":
            cut += 1
        if cut >= end:
            break
        yield data[start:cut].split()
        start = cut
    yield (data[start:] if start else data).split()


def pick(rows: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """One of the ``rows`` for each of the ``chosen`` keys; null keys match each other."""
    right = chosen.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)))
    same = reduce(and_, (rows[k].eqNullSafe(right[f"__k{i}"]) for i, k in enumerate(keys)))
    found = rows.join(right, same, "left_semi")
    order = Window.partitionBy(*keys).orderBy(F.xxhash64(*rows.columns))
    return found.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")
