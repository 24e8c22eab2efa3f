"""Exact groups, near groups and repeated passages against brute force."""

import hashlib
import random
from collections import defaultdict
from itertools import combinations

import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from seqloom.llm import exact, repeats, simhash
from seqloom.llm.components import components

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_exact_groups(docs, rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(AZ)].append(doc_id)
    for keep, choose in (("largest", max), ("smallest", min)):
        found = {r.doc_id: r for r in exact.exact_groups(docs, keep).collect()}
        assert len(found) == len(rows)
        for text, ids in groups.items():
            for i in ids:
                r = found[i]
                assert (r.keep_id, r.group_size, r.kept) == (choose(ids), len(ids), i == choose(ids))
                assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_exact_group_over_many_partitions(spark):
    """One text in half of all rows is dealt to several partitions and is still one group."""
    table = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "Same").otherwise(F.col("id").cast("string")).alias("text")
    )
    rows = exact.exact_groups(table, "largest").filter("doc_id % 2 = 0").collect()
    assert len(rows) == 2000 and {(r.keep_id, r.group_size) for r in rows} == {(3998, 2000)}
    assert [r.doc_id for r in rows if r.kept] == [3998]


def test_exact_odd_rows(odd, empty):
    rows = exact.exact_groups(odd, "largest").collect()
    assert sorted((r.text_sha256[:2], r.group_size, r.keep_id or 0) for r in rows if r.kept) == sorted(
        (hashlib.sha256(t.encode()).hexdigest()[:2], n, k) for t, n, k in (("one two three four", 4, 7), ("five", 1, 0), ("", 3, 9), ("six", 3, 7))
    )
    stay = [(r.doc_id, r.text) for r in exact.without_copies(odd, "largest").collect()]
    assert {(d, (t or "").lower()) for d, t in stay} == {(7, "one two three four"), (None, "five"), (7, "six"), (9, "")}
    kept = exact.without_copies(odd.withColumn("__digest", F.lit(1)), "largest")
    assert kept.columns == ["doc_id", "text"] and kept.count() == 4
    assert exact.exact_groups(empty).count() == 0 and exact.without_copies(empty).count() == 0


def fingerprint(text):
    words = (text or "").translate(AZ).encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_groups(spark, docs, rows):
    prints = {doc_id: fingerprint(text) for doc_id, text in rows}
    links = [(a, b) for a, b in combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = roots(prints, links)
    found = simhash.near_groups(docs).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in found} == {d: (prints[d], want[d]) for d in prints}
    assert len(found) == len(rows)
    stay = simhash.one_per_group(docs)
    assert stay.columns == [c for c in docs.columns if c != "__n"]
    assert sorted(r.doc_id for r in stay.collect()) == sorted(set(want.values()))


def test_fingerprint_hash_is_sparks(spark):
    row = spark.sql("SELECT hex(xxhash64('Éa b c')) AS h").first()
    assert int(row.h, 16) == xxhash.xxh64_intdigest("Éa b c".encode(), 42)


def test_covering_masks_miss_no_pair():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    for a, b in combinations(range(64), 2):
        assert any(not (m >> a & 1) and not (m >> b & 1) for m in masks)


def test_links_of_crowded_buckets(spark, monkeypatch):
    """Large buckets go through variants; the components stay those of all pairs."""
    import random

    draw = random.Random(1)
    base = [draw.getrandbits(63) for _ in range(3)]
    prints = {0, 1, 3, 7, -(2**63)}
    for value in base:
        for _ in range(60):
            prints.add(value ^ sum(1 << b for b in draw.sample(range(63), draw.randrange(0, 5))))
    distinct = spark.createDataFrame([(p,) for p in prints], "fp long")
    pairs = [(a, b) for a, b in combinations(sorted(prints), 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    want = {n: r for n, r in roots(prints, pairs).items()}
    for limit in (1, 4, 1000):
        monkeypatch.setattr(simhash, "PAIR_BUCKET", limit)
        links = {(r.a, r.b) for r in simhash.close_links(distinct).collect()}
        assert links <= {tuple(sorted(p)) for p in pairs}
        assert limit < 1000 or links == {tuple(sorted(p)) for p in pairs}
        assert roots(prints, links) == want


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4])
def test_links_of_other_radii(spark, monkeypatch, radius):
    """Stars of crowded buckets link what pairs do, and nothing beyond the radius."""
    draw = random.Random(radius)
    centre = draw.getrandbits(64)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    prints = {signed(centre ^ sum(1 << b for b in draw.sample(range(20), draw.randrange(0, 4)))) for _ in range(70)}
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    pairs = [(a, b) for a, b in combinations(sorted(prints), 2) if apart(a, b) <= radius]
    distinct = spark.createDataFrame([(p,) for p in prints], "fp long")
    monkeypatch.setattr(simhash, "PAIR_BUCKET", 3)
    links = {(r.a, r.b) for r in simhash.close_links(distinct, radius).collect()}
    assert links <= {tuple(sorted(p)) for p in pairs}
    assert roots(prints, links) == roots(prints, pairs)


def test_radius_that_is_too_wide(spark):
    with pytest.raises(ValueError):
        simhash.close_links(spark.createDataFrame([(1,)], "fp long"), 6)


def test_near_odd_rows(odd, empty):
    rows = simhash.near_groups(odd).collect()
    assert len(rows) == 11
    same = {r.component_id for r in rows if r.fingerprint == f"{fingerprint('one two three four'):016x}"}
    assert same == {7} and {r.component_id for r in rows if r.fingerprint == f"{fingerprint('six'):016x}"} == {3}
    assert {r.component_id for r in rows if r.fingerprint == f"{fingerprint('five'):016x}"} == {None}
    kept = simhash.one_per_group(odd).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 3, 7, 9]
    assert simhash.near_groups(empty).count() == 0 and simhash.one_per_group(empty).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    found = {r.node: r.root for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def repeats_by_hand(rows):
    """Order by id; rows without one come last and are nobody's source."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in ordered]
    for d, words in split:
        for i in range(len(words) - 12):
            first.setdefault(tuple(words[i : i + 13]), d)
    out = []
    for d, words in split:
        keep = [True] * len(words)
        for i in range(len(words) - 12):
            source = first[tuple(words[i : i + 13])]
            if source is not None and (d is None or source < d):
                keep[i : i + 13] = [False] * 13
        kept = b" ".join(w for w, k in zip(words, keep, strict=True) if k)
        out.append((d, len(words), len(words) - sum(keep), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


def test_repeats(docs, rows, monkeypatch):
    found = sorted((tuple(r) for r in repeats.without_repeats(docs).collect()), key=str)
    assert found == repeats_by_hand(rows)
    assert sum(r[2] for r in found) > 300


def test_repeats_in_many_blocks(rows, monkeypatch):
    """Blocks and buckets only decide what is resolved early."""
    import pyarrow as pa

    names = {"text": [t for _, t in rows], "ord": [d for d, _ in rows], "th": [d * 2**40 for d, _ in rows]}
    batch = pa.RecordBatch.from_pydict(names)

    def marks(block, buckets):
        monkeypatch.setattr(repeats, "BLOCK_WORDS", block)
        filed = pa.Table.from_batches(list(repeats.anchors(iter([batch]), buckets))).sort_by("bucket")
        out = pa.Table.from_batches(list(repeats.repeated_anchors(iter(filed.to_batches(max_chunksize=7)))))
        return {(r["ord"], m) for r in out.to_pylist() for m in r["marks"]}

    def words(block, buckets):
        found = marks(block, buckets)
        by_doc = defaultdict(list)
        for order, mark in found:
            by_doc[order].append(mark)
        texts = dict(rows)
        given = [(d, [m]) for d, m in by_doc.items()]
        squeezed = [zstandard.compress((texts[d] or "").encode()) for d, _ in given]
        data = {"packed": squeezed, "ord": [d for d, _ in given], "th": [d for d, _ in given], "marks": [m for _, m in given]}
        schema = pa.schema([("packed", pa.binary()), ("ord", pa.int64()), ("th", pa.int64()), ("marks", pa.list_(pa.list_(pa.int64())))])
        made = repeats.edges(iter([pa.RecordBatch.from_pydict(data, schema)]), buckets)
        table = pa.Table.from_batches(list(made)).sort_by("bucket")
        out = pa.Table.from_batches(list(repeats.later_paths(iter(table.to_batches(max_chunksize=5))))).to_pylist()
        return found, {(r["ord"], r["pos"] + i) for r in out for i in range(r["len"] + 12)}

    found, gone = words(1_000_000, 4)
    assert found and gone
    for block, buckets in ((50, 1), (50, 64), (3000, 3)):
        assert words(block, buckets) == (found, gone)
    monkeypatch.setattr(repeats, "BLOCK_WORDS", 100_000)
    want = {r[0]: r[2] for r in repeats_by_hand(rows)}
    assert {d: sum(1 for o, _ in gone if o == d) for d in want} == want


def test_repeats_odd_rows(spark, odd, empty):
    long = " ".join(f"w{i}" for i in range(20))
    more = [(None, long), (None, long), (7, long + " z"), (7, "z " + long), (7, long + " z"), (8, long), (None, long + " y")]
    table = odd.unionAll(spark.createDataFrame(more, "doc_id long, text string"))
    want = repeats_by_hand([tuple(r) for r in table.collect()])
    assert sorted((tuple(r) for r in repeats.without_repeats(table).collect()), key=str) == want
    assert repeats.without_repeats(empty).count() == 0
