"""Shards of nearly equal bytes by histogram sort.

Every row has a key of 128 bits: the hash of its text, then that of its other columns. Bytes
and rows below candidate boundaries are counted exactly, by one aggregate a round over a narrow
table: the first round counts 256 ranges of keys, each further one cuts the ranges that still
hold a splitter into 256, until every splitter is near enough to its target. Then the rows are
exchanged once. As rows below each splitter are known by then, a row's slot in its shard needs
no further count.

Copies of a text have neighbouring keys. A splitter goes between texts wherever that is near
enough, and through a group of copies only if the group is too large for that.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from seqloom.llm.common import plain, shuffle_parts
from seqloom.session import materialise

SHARDS = 40
#: Bytes that a row counts beside its text.
OVERHEAD = 16
#: How far from its target a splitter may be, as a share of a shard.
TOLERANCE = 0.001
#: Hexadecimal digits of a key, and how many of them a round adds.
KEY_DIGITS, ROUND_DIGITS = 32, 2
#: Sorts behind every hexadecimal digit.
BEHIND = "g"


@dataclass(frozen=True)
class Splitter:
    """Keys below ``key`` come before it; so many bytes and rows do."""

    key: str
    size: int
    rows: int


def row_size(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long") + OVERHEAD


def row_key(columns: list[str], text: str = "text") -> Column:
    """Hexadecimal digits: 16 of the text's hash, 16 of the other columns'."""
    others = [F.col(f"`{c}`").cast("string") for c in columns if c != text]
    digits = lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))
    return F.concat(digits(F.xxhash64(F.col(text).cast("string"))), digits(F.xxhash64(F.lit(7), *others)))


def counts_below(keys: DataFrame, prefixes: list[str], digits: int) -> list[tuple[str, int, int]]:
    """(prefix, bytes, rows) of the ranges with so many digits that begin with one of the ``prefixes``, in order.

    At most 256 for each prefix, of which there are no more than splitters.
    """
    inside = keys if prefixes == [""] else keys.filter(F.substring("key", 1, len(prefixes[0])).isin(prefixes))
    found = inside.groupBy(F.substring("key", 1, digits).alias("prefix")).agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    return sorted((r.prefix, r.size, r.rows) for r in found.collect())


def splitters(keys: DataFrame, parts: int, slack: float) -> list[Splitter]:
    """``parts`` - 1 splitters of rows (key, size), each within ``slack`` bytes of its share.

    A range that holds equal keys only, or a single row, is not cut: the nearer end is taken.
    """
    ranges = counts_below(keys, [""], ROUND_DIGITS)
    total = sum(size for _, size, _ in ranges)
    found: dict[int, Splitter] = {}
    open_ = {i: ("", 0, 0) for i in range(1, parts)}  # splitter: prefix, bytes and rows before it
    digits = ROUND_DIGITS
    while open_:
        within: dict[str, list[tuple[str, int, int]]] = {}
        for r in ranges:
            within.setdefault(r[0][: digits - ROUND_DIGITS], []).append(r)
        further = {}
        for i, (prefix, size, rows) in open_.items():
            target = total * i / parts
            for child, more, n in within.get(prefix, []):
                if size + more > target:
                    break
                size, rows = size + more, rows + n
            else:
                found[i] = Splitter(prefix + BEHIND, size, rows)
                continue
            low, high = target - size, size + more - target
            if min(low, high) <= slack or n == 1 or digits == KEY_DIGITS:
                found[i] = Splitter(child, size, rows) if low <= high else Splitter(child + BEHIND, size + more, rows + n)
            else:
                further[i] = (child, size, rows)
        open_, digits = further, digits + ROUND_DIGITS
        if open_:
            ranges = counts_below(keys, sorted({prefix for prefix, _, _ in open_.values()}), digits)
    return [found[i] for i in range(1, parts)]


def bucket_of(key: Column, edges: list[str]) -> Column:
    """How many of the sorted ``edges`` are not above the key; only edges with its first two digits are compared."""
    leads = [f"{b:02x}" for b in range(256)]
    starts = [bisect_left(edges, lead) for lead in leads]
    stops = [*starts[1:], len(edges)]
    slices = F.array(*(F.array(*map(F.lit, edges[a:b])).cast("array<string>") for a, b in zip(starts, stops, strict=True)))
    lead = F.conv(F.substring(key, 1, 2), 16, 10).cast("int")
    after = F.size(F.filter(F.get(slices, lead), lambda edge: edge <= key))
    return F.get(F.array(*map(F.lit, starts)), lead) + after


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, text: str = "text") -> DataFrame:
    """``docs`` with __size (UTF-8 bytes and 16), __shard (0 to shards - 1) and __slot (gapless from 0).

    Sizes of shards differ by little: each border is within ``tolerance`` of a shard's share, or
    at the nearer end of a row that is larger than that. Null texts count as empty, and all
    rows are kept, also those that repeat an id or have none. Rows that are equal in all
    columns have equal keys and are not parted. Columns whose name starts with two underscores
    are dropped. An empty table gives an empty result. Shards hold the same rows in the same
    slots whenever they are made anew from the same table.
    """
    docs = plain(docs)
    keyed = docs.withColumns({"__size": row_size(text), "__key": row_key(docs.columns, text)})
    keys = materialise(keyed.select(F.col("__key").alias("key"), F.col("__size").alias("size")), "shard-keys")
    fine = -(-shuffle_parts(docs) // shards)  # each shard in so many parts, so that its rows need no single task
    total = keys.agg(F.sum("size")).first()[0] or 0
    edges = splitters(keys, shards * fine, tolerance * total / shards)
    below = [0, *(e.rows for e in edges)]
    bases = [rows - below[i - i % fine] for i, rows in enumerate(below)]
    dealt = keyed.withColumn("__bucket", bucket_of(F.col("__key"), [e.key for e in edges]))
    # one bucket a partition: the number of a row within the sorted partition is that within its bucket
    placed = dealt.repartitionById(shards * fine, F.col("__bucket")).sortWithinPartitions("__key", *docs.columns[:1])
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return placed.select(
        *(f"`{c}`" for c in docs.columns),
        "__size",
        F.floor(F.col("__bucket") / fine).cast("int").alias("__shard"),
        (F.get(F.array(*map(F.lit, bases)), F.col("__bucket")) + row).cast("long").alias("__slot"),
    )


def placed(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row; see ``shard``.

    The law is ``bytes``, which says nothing of other numbers of shards: grown_shard is null.
    """
    found = shard(docs, shards)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return found.select(
        "doc_id",
        F.col("__size").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("__shard").alias("shard"),
        F.col("__slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
