"""Exact duplicates by content sort.

Normalised texts are range-partitioned by sampled splitters and sorted externally, so equal
texts become neighbours, and each row is compared in full with the one before it. The
splitters are drawn from a bounded key (leading bytes, digest of the whole text, document
id), never from whole texts, and the id in the key lets a very large group of copies spread
over many partitions. Only the first and last group of a partition can go on in another one;
these few rows, at most two per partition, are joined by their whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from seqloom.llm.common import pick, plain, shuffle_parts
from seqloom.session import materialise

#: Leading bytes in the key of the splitters; whole texts decide equality.
LEAD_BYTES = 16

KEYED = "doc_id long, norm binary, lead binary, digest binary"
RUNS = (
    "doc_id long, digest binary, part int, run long, first boolean, edge boolean, "
    "edge_text binary, head long, n long"
)
NAMES = [column.split()[0] for column in RUNS.split(", ")]
TYPES = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.int64(), pa.int64()]
FLUSH_ROWS = 10_000


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lower-cased (A-Z only) bytes of each text, their start and SHA-256 digest."""
    for batch in batches:
        norm = pc.ascii_lower(pc.fill_null(batch.column("text"), "")).cast(pa.binary())
        digest = pa.array((hashlib.sha256(x.as_buffer()).digest() for x in norm), pa.binary())
        lead = pc.binary_slice(norm, 0, LEAD_BYTES)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), norm, lead, digest], names=["doc_id", "norm", "lead", "digest"]
        )


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of equal neighbours in a sorted partition, with their size and first id.

    Only the ids of the current group and one text are held. The first and the last group
    of the partition are marked and carry their text.
    """
    out: list[list] = [[] for _ in NAMES]
    text = digest = None
    ids: list = []
    run = part = 0

    def close(edge: bool) -> None:
        n = len(ids)
        values = (
            ids,
            [digest] * n,
            [part] * n,
            [run] * n,
            [True] + [False] * (n - 1),
            [edge] * n,
            [text if edge else None] + [None] * (n - 1),
            [ids[0]] * n,
            [n] * n,
        )
        for column, more in zip(out, values, strict=True):
            column.extend(more)

    def flushed() -> pa.RecordBatch:
        arrays = [pa.array(c, t) for c, t in zip(out, TYPES, strict=True)]
        for column in out:
            column.clear()
        return pa.RecordBatch.from_arrays(arrays, names=NAMES)

    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("part")[0].as_py()
        norm, sums = batch.column("norm"), batch.column("digest").to_pylist()
        for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
            if not (ids and sums[i] == digest and norm[i].as_py() == text):
                if ids:
                    close(edge=run == 0)
                    run += 1
                text, digest, ids = norm[i].as_py(), sums[i], []
                if len(out[0]) >= FLUSH_ROWS:
                    yield flushed()
            ids.append(doc_id)
    if ids:
        close(edge=True)
        yield flushed()


def exact_groups(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Exactly one
    row of each group is kept: the one with the smallest (or largest) id; of rows that repeat
    that id, one. A null id is kept only in a group without other ids. Further columns of
    ``docs`` are ignored. An empty table gives an empty result.
    """
    largest = keep == "largest"
    id_, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(id_.alias("doc_id"), text.alias("text")).mapInArrow(keyed, KEYED)
    order = F.col("doc_id").desc_nulls_last() if largest else F.col("doc_id").asc_nulls_last()
    parted = (
        rows.repartitionByRange(shuffle_parts(docs), F.col("lead"), F.col("digest"), order)
        .sortWithinPartitions("lead", "digest", "norm", order)
        .select("doc_id", "norm", "digest", F.spark_partition_id().alias("part"))
    )
    found = materialise(parted.mapInArrow(runs, RUNS), "exact")
    # groups that may go on in another partition: at most two rows per partition
    group = Window.partitionBy("edge_text")
    across = materialise(
        found.filter("edge and first").select(
            "part",
            "run",
            F.sum("n").over(group).alias("all_n"),
            (F.max("head") if largest else F.min("head")).over(group).alias("keep_id"),
            (F.row_number().over(group.orderBy("part", "run")) == 1).alias("leads"),
        ),
        "exact-edges",
    )
    inner = found.filter("not edge").select(
        "doc_id", F.col("head").alias("keep_id"), F.col("n").alias("group_size"), F.col("first").alias("kept"), "digest"
    )
    split = (
        found.filter("edge")
        .join(across, ["part", "run"])
        .select(
            "doc_id", "keep_id", F.col("all_n").alias("group_size"), (F.col("first") & F.col("leads")).alias("kept"), "digest"
        )
    )
    return inner.unionAll(split).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def with_digest(docs: DataFrame, out: str) -> DataFrame:
    """Add the SHA-256 digest of each normalised text (null: empty)."""
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.BinaryType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            norm = pc.ascii_lower(pc.fill_null(text, "")).cast(pa.binary())
            sums = pa.array((hashlib.sha256(x.as_buffer()).digest() for x in norm), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, sums], names=schema.names)

    return docs.mapInArrow(add, schema)


def without_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns unchanged.

    The kept row is the one ``exact_groups`` marks; of rows that repeat both id and text,
    one stays. Columns whose name starts with two underscores are dropped.
    """
    docs = plain(docs)
    chosen = exact_groups(docs, keep).filter("kept").select("doc_id", F.unhex("text_sha256").alias("__digest"))
    return pick(with_digest(docs, "__digest"), chosen, ["doc_id", "__digest"]).drop("__digest")
