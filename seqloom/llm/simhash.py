"""Near duplicates by SimHash and covering locality-sensitive hashing.

Fingerprints within a small Hamming radius are found without misses: each bit position gets
a non-zero vector of radius + 1 bits, and table v keeps the positions whose vector has an odd
inner product with v. For any `radius` differing positions some v is orthogonal to all their
vectors, so the pair agrees on everything that table keeps.

A bucket of a table with few fingerprints is compared pair by pair. A bucket with many is not:
its fingerprints agree on the kept bits, so each is written with up to half the radius of the
other bits flipped, and fingerprints that share such a variant are within the radius; a star
over each variant carries all links. For an odd radius the centres of stars whose variants
differ in one bit are linked as well. Work stays linear in the bucket.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from seqloom.llm.common import pick, plain, text_bytes, word_blocks
from seqloom.llm.components import components
from seqloom.session import materialise

BITS, RADIUS, SHINGLE = 64, 2, 3
#: Buckets up to this size are compared pair by pair, larger ones through their variants.
PAIR_BUCKET = 32


def shingle_hashes(text: bytes, n: int = SHINGLE) -> Iterator[bytes]:
    """XXH64 (seed 42, big-endian) of the shingles of each block of words."""
    digest, tail = xxhash.xxh64_digest, []
    seen = False
    for words in word_blocks(text.lower()):
        words = tail + words
        if len(words) >= n:
            seen = True
            joined = b" ".join(words)
            stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate(([0], stops[:-n])).tolist()
            ends = (stops[n - 1 :] - 1).tolist()
            yield b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)])
        tail = words[-(n - 1) :] if n > 1 else []
    if not seen and tail:
        yield digest(b" ".join(tail), 42)


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    """SimHash of all shingles: a bit is 1 if set in over half of them; no words give 0."""
    ones, total = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, n):
        for start in range(0, len(hashes), 1 << 19):
            bits = np.unpackbits(np.frombuffer(hashes[start : start + (1 << 19)], np.uint8))
            ones += bits.reshape(-1, BITS).sum(axis=0, dtype=np.int32)
        total += len(hashes) // 8
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of each row; the fingerprint is a signed long."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text, n) for text in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"]
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(apply, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, seed: int = 7) -> list[int]:
    """Masks (signed longs) such that any `radius` bits are all left out by one of them."""
    draw = random.Random(seed)
    vectors = [draw.randrange(1, 2 ** (radius + 1)) for _ in range(BITS)]
    masks = []
    for v in range(1, 2 ** (radius + 1)):
        mask = sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2)
        masks.append(mask - 2**BITS if mask >= 2 ** (BITS - 1) else mask)
    return masks


def close_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) links of fingerprints (column fp) within ``radius`` bits that join all such fingerprints.

    Pairs of small buckets are all there, once each; of large buckets there are the links of
    stars. Every link is within the radius. The number of tables is 2^(radius + 1) - 1 and that
    of variants grows with the power of half the radius, so a radius above 5 is refused.
    """
    if not 0 <= radius <= 5:
        raise ValueError("radius must be 0 to 5")
    masks = covering_masks(radius)
    tables = distinct.select(
        "fp",
        F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks))).alias("t", "key"),
    )
    sizes = materialise(tables.groupBy("t", "key").count().filter("count > 1"), "buckets")
    members = materialise(tables.join(sizes, ["t", "key"]), "members")
    small = members.filter(F.col("count") <= PAIR_BUCKET)
    left, right = small.select("t", "key", F.col("fp").alias("a")), small.select("t", "key", F.col("fp").alias("b"))
    xor = F.col("a").bitwiseXOR(F.col("b"))
    pairs = left.join(right, ["t", "key"]).filter((F.col("a") < F.col("b")) & (F.bit_count(xor) <= radius))
    large = members.filter(F.col("count") > PAIR_BUCKET)
    free = F.array(*(F.array(*(F.lit(_bit(i)) for i in range(BITS) if not m >> i & 1)) for m in masks))
    flips = F.concat(F.array(F.lit(0).cast("long")), F.element_at(free, F.col("t") + 1))
    variants = large.select("t", "fp", F.col("fp").alias("variant"))
    for _ in range(radius // 2):
        flipped = variants.select("t", "fp", "variant", F.explode(flips).alias("flip"))
        variants = flipped.select("t", "fp", F.col("variant").bitwiseXOR(F.col("flip")).alias("variant"))
    found = variants.groupBy("variant").agg(F.min("fp").alias("a"), F.max("fp").alias("top"))
    stars = variants.select("fp", "variant").join(found.filter("a < top"), "variant").filter("a < fp")
    links = pairs.select("a", "b").unionAll(stars.select("a", F.col("fp").alias("b")))
    if radius % 2:
        centres = materialise(variants.groupBy("t", "variant").agg(F.min("fp").alias("fp")), "centres")
        beside = centres.select("t", F.col("fp").alias("other"), "variant", F.explode(flips).alias("flip"))
        beside = beside.select("t", "other", F.col("variant").bitwiseXOR(F.col("flip")).alias("variant"))
        near = centres.join(beside, ["t", "variant"]).filter("fp <> other")
        links = links.unionAll(near.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")))
    return links.distinct()


def _bit(i: int) -> int:
    return -(2**63) if i == 63 else 1 << i


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, fp (signed), fingerprint (16 hex digits), component_id, root.

    Texts are lower-cased (A-Z) and split at ASCII white space; shingles are three words,
    repeats included, or the whole text if it has fewer; null and wordless texts get
    fingerprint zero and are linked like any other. component_id is the smallest doc_id
    reachable over links of at most two differing bits; null ids do not count, and it is null
    only where a component has no id at all. root is the smallest fp of the component. Further
    columns are ignored.
    """
    marked = materialise(fingerprints(docs), "simhash")
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    named = name_components(distinct, components(close_links(distinct)))
    return marked.join(named, "fp").select("doc_id", "fp", text.alias("fingerprint"), "component_id", "root")


def name_components(distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """(fp, root, component_id) of each fp; ``first`` of distinct is the fp's smallest doc_id."""
    roots = roots.withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp").select("fp", "first", "root")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = rooted.join(least, "root").select("fp", "root", "component_id")
    named = distinct.join(linked, "fp", "left").select(
        "fp",
        F.coalesce("root", "fp").alias("root"),
        F.coalesce("component_id", "first").alias("component_id"),
    )
    return materialise(named, "named")  # read plainly, so that Spark can split a hot fingerprint


def one_per_group(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, all columns unchanged.

    It is the row with the smallest id (of rows that repeat this id, one). A component whose
    rows all have no id keeps one row of its smallest fingerprint. Columns whose name starts
    with two underscores are dropped.
    """
    docs = plain(docs)
    return keep_one(docs, materialise(near_groups(docs), "near"), fingerprint)


def keep_one(docs: DataFrame, groups: DataFrame, mark_of: Callable[[bytes], int]) -> DataFrame:
    """One row of ``docs`` for each component of groups (doc_id, fp, component_id, root)."""
    named = groups.filter("doc_id = component_id").select("doc_id").distinct()
    kept = pick(docs.filter("doc_id is not null"), named, ["doc_id"])
    unnamed = groups.filter("component_id is null and fp = root").select(F.col("fp").alias("__fp")).distinct()
    rows = docs.filter("doc_id is null")
    schema = T.StructType([*docs.schema.fields, T.StructField("__fp", T.LongType())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(batch.schema.get_field_index("text")))
            found = pa.array([mark_of(text) for text in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=schema.names)

    return kept.unionAll(pick(rows.mapInArrow(mark, schema), unnamed, ["__fp"]).drop("__fp"))
