"""URL verdicts, mixing, toxicity and the pipeline."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqloom.llm import exact, mixing, near, queries, toxicity, urls

FOLDER = "/root/testdata/sf0.001"


def host_and_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[at:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    az = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return rest[:at].translate(az), path[:end]


def verdict(url, rules):
    host, path = host_and_path(url)
    fits = [
        (len(h + p), len(h), v == "block", h + p, v)
        for v, h, p in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, False, None, "allow"))
    return host, path, best[3], best[4]


RULES = [*urls.RULES, ("block", "org", "/en"), ("allow", "a.org", "/engl"), ("block", "", ""), ("block", "b.org", "/x/y"), ("allow", "b.org", "/x/y")]


@pytest.mark.parametrize("rules", [urls.RULES, RULES[:-3] + RULES[-2:]])
def test_url_verdicts(spark, rules):
    draw = random.Random(4)
    hosts = ["com", "EXAMPLE.com", "www.example.com", "x.www.Example.com", "badexample.com", "net", "a.net", "a.org", "b.org", "", "org.", "É.com"]
    paths = ["", "/", "/en/", "/en/1", "/es/x?y#z", "/fr/", "#en/", "?/en/", "/english", "/x/y/z", "/x/yz", "//en/", "/en/a://b/c"]
    made = [(i, draw.choice(["http", "https", ""]) + "://" + draw.choice(hosts) + draw.choice(paths)) for i in range(400)]
    made += [(1000, None), (1001, ""), (1002, "no-scheme.com/en/"), (None, "http://a.net/es/"), (1, "http://a.net/fr/\nx"), (1003, "x://" + "a." * 60 + "com" + "/d" * 60)]
    table = spark.createDataFrame(made, "page_id long, url string").selectExpr("*", "'h' as host", "1 as key", "2 as row")
    found = Counter(tuple(r) for r in urls.judge(table, rules).collect())
    assert found == Counter((i, *verdict(u, rules)) for i, u in made)
    by_table = urls.judge(table, urls.rule_table(spark, rules))
    assert Counter(tuple(r) for r in by_table.collect()) == found
    assert urls.judge(table.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge(table, []).collect()} == {"allow"}


@pytest.fixture(scope="module")
def sourced(spark):
    rows = [(i, f"text of {i} " * (i % 7), "en", "big" if i % 3 else f"s{i % 4}", None) for i in range(3000)]
    rows += [(None, "no id", "en", None, 1), (None, None, None, None, None), (5000, None, "en", "silent", 0), (5000, None, "en", "silent", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_mixing_meets_its_weights(sourced):
    mixed = mixing.mix(sourced.withColumn("__copy", F.lit("x")).withColumn("count", F.lit(1)))
    assert mixed.columns == [*sourced.columns, "count", "__copy", "__shuffle"]
    chars = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    sizes = [chars[s] for s in ("big", "s0", "s1", "s2", "s3")]
    assert max(sizes) < 1.25 * min(sizes)
    counts = mixed.groupBy("doc_id", "source").agg(F.count("*").alias("n"), F.max("__copy").alias("top"), F.countDistinct("__copy").alias("d"))
    assert counts.filter("doc_id < 3000 and (n <> d or top <> n - 1)").count() == 0
    again = mixing.mix(sourced).select("doc_id", "__copy", "__shuffle")
    assert sorted(map(str, again.collect())) == sorted(map(str, mixed.select("doc_id", "__copy", "__shuffle").collect()))


def test_mixing_weights_and_rates(sourced, empty):
    rates = {r.source: r for r in mixing.source_rates(sourced, {"big": 3, "s0": 1, None: 1}, growth=2.0).collect()}
    sizes = {r.source: r.n for r in sourced.groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n")).collect()}
    total = sum(sizes.values())
    assert rates["s1"].rate == 0 and rates["silent"].rate == 2.0
    assert rates["big"].rate == pytest.approx(3 / 5 * total * 2 / sizes["big"])
    rare = rates[None]
    assert rare.rate > mixing.LARGEST_RATE and rare.draws == -(-rare.rate // mixing.LARGEST_RATE)
    n = mixing.mix(sourced, {"big": 3, "s0": 1, None: 1}, growth=2.0).filter("source is null and text is not null").count()
    assert abs(n - rare.rate) < 6 * rare.rate**0.5
    assert mixing.mix(empty).count() == 0


def test_poisson_table(spark):
    for rate in (0.0, 0.3, 4.0, 32.0):
        got = spark.range(1).select(mixing.thresholds(F.lit(rate)).alias("t")).first().t
        term, total, want = np.exp(-rate), np.exp(-rate), []
        for k in range(1, len(got) + 1):
            want.append(total)
            term *= rate / k
            total += term
        assert np.allclose(got, want, rtol=1e-12) and got[-1] > 1 - 1e-12


@pytest.fixture(scope="module")
def toxic(spark):
    """Toxic texts hold some of twelve words that others do not."""
    draw = random.Random(6)
    bad, good = [f"vile{i}" for i in range(12)], [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        words = draw.choices(good, k=draw.randrange(5, 200))
        mark = int(i % 8 == 0)
        words += draw.sample(bad, 3) * mark
        draw.shuffle(words)
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, 1, mark))
    rows += [(None, None), (None, "vile1 vile2"), (2000, ""), (2000, None)]
    labels += [(None, None, None), (0, 1, 1), (3, None, None)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as toxic")
    return texts, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i for i in range(0, 1500, 8)}


def test_toxicity_on_held_out_rows(toxic):
    docs, labels, bad = toxic
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == 1504
    named = {r.doc_id: r for r in found if r.doc_id is not None and r.doc_id < 1500}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in named.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    held = [(r.predicted, d in bad) for d, r in named.items() if r.held_out]
    caught = sum(p and t for p, t in held)
    assert caught >= 0.9 * sum(t for _, t in held) and sum(p and not t for p, t in held) <= 0.02 * len(held)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in found)


def test_labels_of_held_out_rows_are_not_used(toxic):
    docs, labels, _ = toxic
    model = toxicity.learn(docs, labels)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.learn(docs, turned)
    assert (model.weights == again.weights).all() and model.bias == again.bias


def test_other_columns_change_no_score(toxic):
    """lang, source and an id of the same fold are no inputs; nor is how rows are dealt."""
    docs, labels, _ = toxic
    kept = docs.filter("doc_id < 1500")
    model = toxicity.learn(kept.withColumns({"lang": F.lit("en"), "source": F.col("doc_id").cast("string")}), labels)
    moved = {i: next(j for j in range(10**6 + 40 * i, 10**7) if (zlib.crc32(str(j).encode()) % 5 == 0) == (zlib.crc32(str(i).encode()) % 5 == 0)) for i in range(1500)}
    names = docs.sparkSession.createDataFrame(list(moved.items()), "doc_id long, other long")
    renamed = lambda t: t.join(names, "doc_id").drop("doc_id").withColumnRenamed("other", "doc_id")
    other = toxicity.learn(renamed(kept).withColumns({"lang": F.lit("xx"), "source": F.lit(None)}).repartition(7), renamed(labels))
    assert model.features == other.features and np.array_equal(model.weights, other.weights) and model.bias == other.bias
    assert np.array_equal(model.groups, other.groups) and np.array_equal(model.allowed, other.allowed)


def test_features_are_counted_over_all_rows(toxic):
    """Counts of features, of all rows and by kind of text, against brute force; a sample bounds the gradient alone."""
    docs, labels, bad = toxic
    marked = docs.filter("doc_id < 1500")
    texts = {r.doc_id: r.text for r in marked.collect()}
    want = Counter(x for d, t in texts.items() for x in {"", *toxicity.text_features(t)[1]})
    toxic_want = Counter(x for d, t in texts.items() if d in bad for x in {"", *toxicity.text_features(t)[1]})
    each = (toxicity.feature_counts(of) for of in (marked.filter("doc_id % 8 = 0"), marked))
    found = {r.feature: (r.p, r.u) for r in toxicity.side_by_side(*each, ["feature"]).collect()}
    assert found == {x: (toxic_want[x], n) for x, n in want.items()}
    kinds = toxicity.Kinds(["w1", "w2"], np.eye(2, dtype=np.float32))
    held = Counter()
    for d, t in texts.items():
        words = set(t.split())
        kind = int("w2" in words and "w1" not in words)
        for i, x in enumerate(["=vile1", "=w5"]):
            held[kind, i] += x[1:] in words
        held[kind, -1] += 1
        held[kind, -2] += len(t.split())
    by_kind = {(r.kind, r.feature): r.n for r in toxicity.kind_counts(marked, ["=vile1", "=w5"], kinds).collect()}
    assert by_kind == {k: n for k, n in held.items() if n}
    few = toxicity.learn(docs, labels, most_positive=20, most_unlabelled=60)
    assert {f"=vile{i}" for i in range(12)} <= set(few.features)
    assert all(few.weights[few.features.index(f"=vile{i}")] > 0 for i in range(12))


def test_risk_of_one_step():
    """The first gradient step of the fit against the risk differentiated by hand."""
    known = toxicity.Rows([np.array([0]), np.array([0, 1])], np.array([1, 2]))
    others = toxicity.Rows([np.array([0]), np.array([1]), np.zeros(0, np.int64), np.zeros(0, np.int64)], np.array([1, 1, 3, 4]))
    prior, bias = 0.25, np.log(0.25 / 0.75)

    def risk(weights, p, u):
        margin = lambda rows, picks: np.array([bias + weights[rows.ids[i]].sum() for i in picks])
        fp, fu = margin(known, p), margin(others, u)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        return prior * np.logaddexp(0, -fp).mean() + negative if negative >= 0 else -negative

    drawn, each = np.random.default_rng(5), 1e-6
    p, u = drawn.integers(0, 2, 32), drawn.integers(0, 4, 4)
    slope = [(risk(np.eye(2)[i] * each, p, u) - risk(-np.eye(2)[i] * each, p, u)) / (2 * each) for i in range(2)]
    weights = toxicity.descend(known.ids, others.ids, 2, prior, epochs=1, batch=4, decay=0.0)
    moved = np.maximum(0, -0.05 * np.sign(slope))  # Adam's first step is the rate against the sign
    assert np.allclose(weights, moved, atol=1e-5)


def test_toxicity_without_labels(toxic, empty):
    docs, labels, _ = toxic
    scores = {r.score for r in toxicity.toxicity(docs, labels.filter("toxic = 0")).collect()}
    assert len(scores) == 1 and scores.pop() == pytest.approx(toxicity.PRIOR)
    assert toxicity.toxicity(empty, labels).count() == 0 and toxicity.toxicity(empty, labels.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_pipeline(spark):
    """Each stage against what its operator says about the stage's own input."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, FOLDER).cache()
        kept[name] = before, docs
        assert name == "packing" or docs.columns == columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    before, after = kept["toxicity"]
    assert ids(after) == sorted(r.doc_id for r in toxicity.toxicity(before, labels).collect() if not r.predicted)
    before, after = kept["exact dedup"]
    assert ids(after) == ids(exact.exact_groups(before, "largest").filter("kept"))
    assert len(ids(after)) == len({(r.text or "").lower() for r in before.collect()})
    before, after = kept["near dedup"]
    assert ids(after) == sorted({r.component_id for r in near.near_groups(before).collect()})
    before, after = kept["mixing"]
    assert ids(after) == ids(mixing.mix(before)) and set(ids(after)) <= set(ids(before))
    before, after = kept["packing"]
    assert Counter(ids(before)) == Counter(ids(after.filter("start = 0")))
    whole = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(str, whole.select("doc_id", "start", "doc_tokens").filter("start = 0").collect())) == sorted(
        map(str, after.select("doc_id", "start", "doc_tokens").filter("start = 0").collect())
    )


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Null, empty, repeated and id-less rows, a further column, and empty tables."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (2, text.upper(), "en", "a"), (3, text + " tail", None, None)]
    rows += [(None, text, "en", "a"), (None, "no id at all", "en", "a"), (4, None, "en", "a"), (5, "", "en", "a"), (6, "x", "en", "a")]
    made = spark.createDataFrame([(*r, None, "more") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, __copy string")
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    for name, table in (("odd", made), ("none", made.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    kept = {}
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{tmp_path}/odd").cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        kept[name] = sorted((r.doc_id or 0, r.text or "") for r in docs.collect())
    assert len(kept["toxicity"]) == 9
    assert [d for d, _ in kept["exact dedup"]] == [0, 2, 3, 5, 6]
    assert [d for d, _ in kept["near dedup"]] == [0, 2, 5, 6]
    whole = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r.doc_id or 0 for r in whole} <= {0, 2, 5, 6} and len({(r.row, r.start) for r in whole}) == len(whole)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_every_operator_has_a_query():
    assert [f"op{n}_" for n in range(1, 14)] == sorted({q.split("_")[0] + "_" for q in queries.QUERIES}, key=lambda x: int(x[2:-1]))
