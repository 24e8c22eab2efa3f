"""Fronts of many pairs are listed together, and hold what those of each pair hold."""

import random

from pyspark.sql import functions as F

from seqloom.kernels import dags, pairs, waves
from seqloom.operators import graph_align


def small_pairs(count, seed):
    rng = random.Random(seed)
    word = lambda most: "".join(rng.choices("ACé", k=rng.randint(0, most)))
    return [([word(6) for _ in range(4)], word(14)) for _ in range(count)]


#: Segment 1 goes on in 2 or 3, both in 4.
LINKS = [(1, 2), (1, 3), (2, 4), (3, 4)]


def test_fronts_of_many_pairs_grow_together(monkeypatch):
    grown = []
    monkeypatch.setattr(waves, "grow", lambda *a, grow=waves.grow, **k: grown.append(a[1]) or grow(*a, **k))
    made = small_pairs(300, 41)
    graphs = [dags.Graph([pairs.symbols(t) for t in texts], [[], [0], [0], [1, 2]]) for texts, _ in made]
    patterns = [pairs.symbols(p) for _, p in made]
    want = {i: set(zip(*(c.tolist() for c in waves.front_rows(g, p)))) for i, (g, p) in enumerate(zip(graphs, patterns))}
    for cells, most in ((1, 300), (5000, 60), (1 << 18, 1)):
        grown.clear()
        found = {i: set() for i in want}
        for columns in waves.all_front_rows(graphs, patterns, cells=cells):
            for pair, *row in zip(*(c.tolist() for c in columns)):
                assert tuple(row) not in found[pair]
                found[pair].add(tuple(row))
        assert found == want and sum(grown) == 300 and len(grown) <= most
    assert list(waves.all_front_rows([], [])) == []


def test_listed_fronts_are_those_of_the_table(spark, monkeypatch):
    made = small_pairs(60, 42)
    segments = spark.createDataFrame([(g, v + 1, t) for g, (ts, _) in enumerate(made) for v, t in enumerate(ts)], "graph_id long, segment_id long, sequence string")
    edges = spark.createDataFrame([(g, a, b, 1, i) for g in range(60) for i, (a, b) in enumerate(LINKS)], "graph_id long, src long, dst long, weight long, ord int")
    asked = [(g, q, p) for g, (_, p) in enumerate(made) for q in (0, 1)] + [(0, 2, None), (99, 0, "A")]
    queries = spark.createDataFrame(asked, "graph_id long, query_id long, pattern string")
    monkeypatch.setattr(graph_align, "FLUSH_ROWS", 1000)
    ends = graph_align.align_graphs(queries, segments, edges).select("graph_id", "query_id", F.col("score").alias("end"))
    cells = graph_align.table_cells(queries, segments, edges).join(ends, ["graph_id", "query_id"]).filter("score <= end")
    want = cells.groupBy("graph_id", "query_id", F.col("score").alias("distance"), "segment", (F.col("h") - F.col("v")).alias("k")).agg(F.max("h").alias("reach"))
    found = graph_align.front_cells(queries, segments, edges)
    assert found.schema["distance"].dataType.simpleString() == found.schema["reach"].dataType.simpleString() == "int"
    assert sorted(found.collect()) == sorted(want.select(found.columns).collect())
