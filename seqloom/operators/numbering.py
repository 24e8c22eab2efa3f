"""Positions within a key, also where one key holds a large share of all rows.

A window over the key would sort such a key in one task. Here the rows are
range-partitioned on (key, order), so a hot key spreads over many partitions; each
partition counts its own runs while streaming, and only the key at the head of a
partition needs the count of the partitions before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from seqloom.session import materialise

PART, RUN = "__part", "__run"


def run_positions(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Append the position of each row within its run of equal keys (input is sorted)."""
    last_key, seen = None, 0
    for batch in batches:
        size = batch.num_rows
        if size == 0:
            continue
        breaks = np.zeros(size, dtype=bool)
        for key in keys:
            column = batch.column(key)
            here, before = column.slice(1), column.slice(0, size - 1)
            changed = pc.fill_null(pc.not_equal(here, before), False)
            one_null = pc.xor(pc.is_null(here), pc.is_null(before))
            breaks[1:] |= pc.or_(changed, one_null).to_numpy(zero_copy_only=False)
        head = [batch.column(key)[0].as_py() for key in keys]
        breaks[0] = head != last_key
        row = np.arange(size)
        start = np.maximum.accumulate(np.where(breaks, row, -1))
        run = np.where(start >= 0, row - start, row + seen).astype(np.int64)
        last_key = [batch.column(key)[size - 1].as_py() for key in keys]
        seen = int(run[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(run)], names=[*batch.schema.names, RUN]
        )


def number_within(df: DataFrame, keys: list[str], order: list[str], out: str = "pos") -> DataFrame:
    """Add ``out``: 0-based position of each row within ``keys`` by the unique ``order``.

    Null keys are a key of their own.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        df.repartitionByRange(parts, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn(PART, F.spark_partition_id())
    )
    schema = T.StructType([*ranged.schema.fields, T.StructField(RUN, T.LongType())])
    local = materialise(
        ranged.mapInArrow(lambda batches: run_positions(batches, keys), schema), "runs"
    )
    # one row per (partition, key); a key has at most `parts` of them
    pieces = local.groupBy(PART, *keys).agg((F.max(RUN) + 1).alias("__rows"))
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        pieces.withColumn("__before", F.sum("__rows").over(before))
        .filter("__before > 0")
        .drop("__rows")
    )
    # Ranges are contiguous, so only the first key of a partition can have rows before
    # it: `carried` has fewer rows than there are partitions, whatever the data size.
    names = {k: f"__of_{k}" for k in [PART, *keys]}
    carried = carried.select(*(F.col(k).alias(n) for k, n in names.items()), "__before")
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()))
    return (
        local.join(F.broadcast(carried), same, "left")
        .drop(*names.values())
        .withColumn(out, F.col(RUN) + F.coalesce("__before", F.lit(0)))
        .drop(PART, RUN, "__before")
    )
