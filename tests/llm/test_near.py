"""Near duplicates by shared shingles against brute force."""

import os
import random
from collections import Counter
from itertools import combinations

import pytest

import corpus_pipeline
from seqloom.llm import mixing, near
from test_llm_groups import AZ, roots

FOLDER = "/root/testdata/sf0.001"


def sets_of(rows):
    found = {}
    for doc_id, text in rows:
        words = (text or "").translate(AZ).encode().split()
        runs = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        found[doc_id] = runs or ({tuple(words)} if words else set())
    return found


def pairs_by_hand(rows):
    found = sets_of(rows)
    similar = lambda x, y: 5 * len(x & y) >= 4 * len(x | y)
    return [(a, b) for a, b in combinations(sorted(found), 2) if similar(found[a], found[b])]


def texts(seed, originals, copies, least, most):
    """Texts and copies of them with some words replaced: similarities on both sides of 0.8."""
    draw, rows = random.Random(seed), []
    word = lambda: f"w{draw.randrange(5000)}"
    for i in range(originals):
        words = [word() for _ in range(draw.randrange(least, most))]
        rows.append((1000 * i, " ".join(words)))
        for j in range(copies):
            other = list(words)
            for _ in range(draw.randrange(1, 2 + len(words) // 50)):
                other[draw.randrange(len(words))] = word()
            rows.append((1000 * i + 1 + j, " ".join(other)))
    return rows


def test_near_texts(spark, monkeypatch):
    """All pairs at 0.8 and no others decide the components, however crowded keys are linked."""
    rows = texts(4, 12, 25, 8, 400)
    links = pairs_by_hand(rows)
    want = roots([d for d, _ in rows], links)
    assert 300 < len(links) < 12 * 26 * 25 // 2 - 300 and 12 < len(set(want.values())) < len(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for limit in (32, 2):
        monkeypatch.setattr(near, "PAIR_BUCKET", limit)
        found = near.near_groups(table).collect()
        assert len(found) == len(rows) and {r.doc_id: r.component_id for r in found} == want


def test_templates_do_not_meet_pair_by_pair(spark, monkeypatch):
    """Texts that share 220 of 290 words link nothing, and pairs compared grow as the texts do."""
    draw, compared = random.Random(5), []
    common, checked = [f"c{i}" for i in range(220)], near.checked
    monkeypatch.setattr(near, "checked", lambda pairs, sets: compared.append(pairs.count()) or checked(pairs, sets))
    totals = []
    for n in (100, 200, 400):
        rows = [(i, " ".join(common + [f"x{i}y{j}" for j in range(70)])) for i in range(n)]
        draw.shuffle(rows)
        found = near.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert all(r.component_id == r.doc_id for r in found)
        totals.append(sum(compared))
        compared.clear()
    assert totals[2] < 6 * totals[0] and totals[2] < 400 * 399 // 20


def test_crowded_texts_that_are_near_are_linked(spark):
    """Near copies of several texts, all of them within one template."""
    draw = random.Random(6)
    common, rows = [f"c{i}" for i in range(200)], []
    for i in range(60):
        own = [f"x{i}y{j}" for j in range(80)]
        for copy in range(3):
            other = list(own)
            other[draw.randrange(80)] = f"z{i}{copy}"
            rows.append((10 * i + copy, " ".join(common + other)))
    want = roots([d for d, _ in rows], pairs_by_hand(rows))
    assert len(set(want.values())) == 60
    found = near.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == want


def test_near_stage_of_the_pipeline(spark):
    """A copy with one word replaced goes, a text that shares half stays."""
    draw = random.Random(8)
    rows = []
    for i in range(40):
        words = [f"w{draw.randrange(9000)}" for _ in range(draw.randrange(100, 2000))]
        other, half = list(words), words[: len(words) // 2] + [f"v{i}x{j}" for j in range(len(words) // 2)]
        other[draw.randrange(len(words))] = "replaced"
        rows += [(i, " ".join(words)), (100 + i, " ".join(other)), (200 + i, " ".join(half))]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "1 n_chars")
    kept = corpus_pipeline.near_dedup(spark, table, "")
    assert sorted(r.doc_id for r in kept.collect()) == [*range(40), *range(200, 240)]


def test_near_texts_odd_rows(docs, rows, odd, empty):
    found = near.near_groups(docs).collect()
    assert {r.doc_id: r.component_id for r in found} == roots([d for d, _ in rows], pairs_by_hand(rows))
    assert near.one_per_group(docs).columns == [c for c in docs.columns if c != "__n"]
    kept = near.one_per_group(odd).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 3, 7, 9]
    assert near.near_groups(empty).count() == 0 and near.one_per_group(empty).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_pipeline_from_the_near_stage_on(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[1:]:
        before, docs = docs, stage(spark, docs, FOLDER).cache()
        kept[name] = before, docs
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    before, after = kept["near dedup"]
    texts = [(r.doc_id, r.text) for r in before.collect()]
    assert ids(after) == sorted(set(roots([d for d, _ in texts], pairs_by_hand(texts)).values()))
    assert len(ids(after)) < len(texts)
    before, after = kept["mixing"]
    assert ids(after) == ids(mixing.mix(before)) and set(ids(after)) <= set(ids(before))
    before, after = kept["packing"]
    assert Counter(ids(before)) == Counter(ids(after.filter("start = 0")))
