"""Context-triggered piecewise hashing of documents.

A rolling hash over seven bytes cuts a text wherever it meets a trigger, so cuts depend on
the content around them only; each piece becomes one character of the signature. A text has
signatures at two neighbouring block sizes, and two texts are compared by the edit distance
of signatures of equal block size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seqloom.llm.common import shuffle_parts
from seqloom.session import materialise

WINDOW = 7
LEAST_BLOCK, PIECES = 3, 64
#: Signatures count as alike only if they share a run of this many characters.
RUN = 4
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

ROW = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, next_fingerprint string"
)
CHAIN = f"{ROW}, part int, first_text string, last_text string"
NAMES = [column.split()[0] for column in ROW.split(", ")]


def rolling(data: bytes) -> np.ndarray:
    """A 32-bit hash of the seven bytes that end at each place."""
    padded = np.zeros(len(data) + WINDOW - 1, np.uint32)
    padded[WINDOW - 1 :] = np.frombuffer(data, np.uint8)
    total = np.zeros(len(data), np.uint32)
    for back in range(WINDOW):
        total *= np.uint32(0x01000193)
        total += padded[back : back + len(data)] + np.uint32(1)
    total ^= total >> np.uint32(15)
    total *= np.uint32(0x2C1B3C6D)
    return total ^ (total >> np.uint32(13))


def signature(data: bytes, hashes: np.ndarray, block: int) -> str:
    """A letter for each piece that ends at a trigger of this block size, and for the rest."""
    ends = np.flatnonzero(hashes % np.uint32(block) == block - 1) + 1
    starts = [0, *ends.tolist()]
    stops = [*ends.tolist(), len(data)]
    return "".join([LETTERS[crc32(data[a:b]) & 63] for a, b in zip(starts, stops, strict=True) if a < b])


def fingerprint(text: bytes) -> str:
    """block:signature:signature at twice the block; an empty text gives the least block.

    The block is the smallest power of two times LEAST_BLOCK that makes at most about PIECES
    pieces. It follows from the length alone, so texts of up to twice the length stay
    comparable whatever they hold. Signatures are whole, they are never cut off.
    """
    block = LEAST_BLOCK
    while block * PIECES < len(text):
        block *= 2
    hashes = rolling(text)
    return f"{block}:{signature(text, hashes, block)}:{signature(text, hashes, 2 * block)}"


def edited(text: str, following: str) -> str:
    """The last half of the characters replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    types = [pa.int64(), pa.int64()] + [pa.string()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=NAMES)


def _made(doc_id, text: str, own: str, following: str, theirs: str) -> tuple:
    data = edited(text, following).encode()
    return doc_id, len(text), hashlib.sha256(data).hexdigest(), own, fingerprint(data), theirs


def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition with what the row after each gives.

    The last row lacks that; it comes as a row with the partition's number, its first text
    and the last text.
    """
    before = part = first = None
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = fingerprint(text.encode())
            if before:
                out.append(_made(*before, text, own))
            else:
                part, first = batch.column("part")[0].as_py(), text
            before = doc_id, text, own
        if out:
            yield _with_border(_rows(out), None)
    if before:
        last = (before[0], len(before[1]), "", before[2], "", "")
        yield _with_border(_rows([last]), (part, first, before[1]))


def _with_border(rows: pa.RecordBatch, border: tuple | None) -> pa.RecordBatch:
    values = border or (None, None, None)
    types = (pa.int32(), pa.string(), pa.string())
    more = [pa.array([v] * rows.num_rows, t) for v, t in zip(values, types, strict=True)]
    return pa.RecordBatch.from_arrays([*rows.columns, *more], names=[*NAMES, "part", "first_text", "last_text"])


def of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, after = (batch.column(c).to_pylist() for c in ("last_id", "last_text", "after"))
        out = [
            _made(i, t, fingerprint(t.encode()), n, fingerprint(n.encode()))
            for i, t, n in zip(ids, texts, after, strict=True)
        ]
        if out:
            yield _rows(out)


def _alike(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length, 0 without a common run."""
    longest, shortest = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    last = lambda s: F.greatest(F.lit(1), F.length(s) - (RUN - 1))
    starts = lambda s: F.transform(F.sequence(F.lit(1), last(s)), lambda i: s.substr(i, F.lit(RUN)))
    near = 1 - F.levenshtein(a, b) / longest
    apart = (shortest >= RUN) & ~F.arrays_overlap(starts(a), starts(b))
    return F.when((longest == 0) | (a == b), 1.0).when(apart, 0.0).otherwise(near)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the best over block sizes that both fingerprints have; 1 if they are equal."""
    parts = lambda x: F.split(x, ":", -1)
    size = lambda x: parts(x)[0].cast("long")
    same = F.greatest(_alike(parts(a)[1], parts(b)[1]), _alike(parts(a)[2], parts(b)[2]))
    return (
        F.when(a == b, 1.0)
        .when(size(a) == size(b), same)
        .when(size(a) == 2 * size(b), _alike(parts(a)[1], parts(b)[2]))
        .when(2 * size(a) == size(b), _alike(parts(a)[2], parts(b)[1]))
        .otherwise(0.0)
    )


def fingerprint_chain(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Each document is followed by the one with the next larger doc_id, the last by the first;
    rows without an id come last, and rows that repeat an id are ordered by their text. A
    document alone follows itself. Null texts are empty. Further columns are ignored.

    Documents are range-partitioned by id and read in order; only the last document of a
    partition needs the first of the next one, and these few are joined by partition number.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("text")]
    placed = rows.repartitionByRange(shuffle_parts(docs), *order[:2]).sortWithinPartitions(*order)
    # written once: borders of partitions must be those of the rows
    numbered = placed.withColumn("part", F.spark_partition_id())
    found = materialise(numbered.mapInArrow(in_order, CHAIN), "chain")
    inside = found.filter("part is null").select(*NAMES)
    ends = found.filter("part is not null")
    parts = sorted(r.part for r in ends.select("part").collect())  # as many numbers as partitions
    follower = dict(zip(parts, parts[1:] + parts[:1], strict=True))
    if parts:
        turn = F.create_map(*(F.lit(x) for item in follower.items() for x in item))
        after = ends.select(F.col("part").alias("next_part"), F.col("first_text").alias("after"))
        last = ends.select(F.col("doc_id").alias("last_id"), "last_text", turn[F.col("part")].alias("next_part"))
        pairs = last.join(after, "next_part").select("last_id", "last_text", "after")
        inside = inside.unionAll(pairs.mapInArrow(of_pairs, ROW))
    near = likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited")
    following = likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next")
    return inside.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near, following)
