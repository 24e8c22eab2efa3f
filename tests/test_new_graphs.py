"""Cycles, graphs grown by alignment, free ends, listings and graph files."""

import glob
import random
from collections import Counter

import pytest
from brute import gap_affine, levenshtein, replay
from pyspark.sql import functions as F

from seqloom.kernels.affine import Penalties
from seqloom.operators import export, graph_align, ranking, segments as seg
from seqloom.operators.affine import affine_align, affine_graph_align, affine_graph_cost
from seqloom.operators.aligned_growth import aligned_growth
from seqloom.operators.cycles import cycles
from seqloom.operators.pairwise import score_rows
from seqloom.sources.graph_files import GraphFiles, GraphFilesWriter, Written, in_line_order

EDGES = "graph_id long, src long, dst long, weight long, ord int"


def test_cycles_against_reachability(spark):
    rng = random.Random(31)
    made, want = [], set()
    for g in range(25):
        n = rng.randint(1, 9)
        links = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 14))}
        made += [(g, a, b) for a, b in links] * rng.choice([1, 2])
        reach = {(a, b) for a, b in links}
        while more := {(a, d) for a, b in reach for c, d in links if b == c} - reach:
            reach |= more
        for v in range(n):
            inside = [w for w in range(n) if (v, w) in reach and (w, v) in reach]
            if inside:
                want.add((g, v, min(inside), len(inside)))
    made += [(None, 1, 1), (30, None, 1), (30, 1, None)]
    found = cycles(spark.createDataFrame(made, "graph_id long, src long, dst long"))
    assert Counter(map(tuple, found.collect())) == Counter(want)
    assert cycles(spark.createDataFrame([], "graph_id long, src string, dst string")).count() == 0


def test_grown_graphs(spark):
    """Whole graphs in any partitioning: paths spell their texts, ranks exist, scores are distances to some path."""
    rng = random.Random(32)
    rows = [(g, r, "".join(rng.choices("ACGé", k=rng.randint(0, 12)))) for g in range(30) for r in range(rng.randint(1, 5))]
    rows += [(99, 0, None), (99, 3, "AC"), (99, 7, "AC"), (None, 0, "ACA"), (None, 1, "AA")]
    graph, scores = aligned_growth(spark.createDataFrame(rows, "graph_id long, seq_rank long, seq string").repartition(3))
    symbols = {(r.graph_id, r.node_id): r.symbol for r in graph.nodes.collect()}
    spelled = {}
    for r in graph.paths.orderBy("graph_id", "seq_rank", "pos").collect():
        spelled[r.graph_id, r.seq_rank] = spelled.get((r.graph_id, r.seq_rank), "") + symbols[r.graph_id, r.node_id]
    assert spelled == {(g, r): s for g, r, s in rows if s}
    found = {(r.graph_id, r.seq_rank): r.score for r in scores.collect()}
    assert set(found) == {(g, r) for g, r, _ in rows} and found[99, 7] == 0 and found[None, 1] == 1
    first = {g: s for g, r, s in rows if r == 0}
    assert all(found[g, r] == levenshtein(first[g], s) for g, r, s in rows if r == 1 and first[g] and s)
    ranks = ranking.ranks(graph.nodes.filter("graph_id is not null"), graph.edges().filter("graph_id is not null"))
    assert ranks.count() == sum(g is not None for g, _ in symbols)
    assert aligned_growth(spark.createDataFrame([], "graph_id long, seq_rank long, seq string"))[1].count() == 0


@pytest.fixture(scope="module")
def small_graphs(spark):
    rng = random.Random(33)
    segments, edges, queries = [], [], []
    for g in range(12):
        n = rng.randint(1, 6)
        segments += [(g, v, "".join(rng.choices("AC", k=rng.randint(0, 4)))) for v in range(n)]
        edges += [(g, u, v, 1, i) for i, (u, v) in enumerate((u, v) for v in range(n) for u in range(v) if rng.random() < 0.5)]
        queries += [(g, q, "".join(rng.choices("AC", k=rng.randint(0, 8)))) for q in range(3)]
    queries += [(0, 90, None), (500, 91, "AC")]
    return (
        spark.createDataFrame(segments, "graph_id long, segment_id long, sequence string"),
        spark.createDataFrame(edges, EDGES),
        spark.createDataFrame(queries, "graph_id long, query_id long, pattern string").repartition(3),
    )


def test_free_ends_agree(small_graphs):
    """Three methods, scores of replayed paths; queries without text or graph have no row."""
    segments, edges, queries = small_graphs
    texts = {(r.graph_id, r.segment_id): r.sequence for r in segments.collect()}
    patterns = {(r.graph_id, r.query_id): r.pattern for r in queries.collect()}
    scores = []
    for method in ("table", "wavefront", "levels"):
        found = graph_align.align_graphs(queries, segments, edges, method, end="query").collect()
        scores.append({(r.graph_id, r.query_id): r.score for r in found})
        for r in found:
            ops = "".join(s.ops for s in r.path)
            spelled = "".join(texts[r.graph_id, s.segment] for s in r.path)[: len(ops) - ops.count("D")]
            assert replay(patterns[r.graph_id, r.query_id], spelled, ops) == r.score
    assert scores[0] == scores[1] == scores[2] and len(scores[0]) == 36


def test_affine_paths_and_costs(small_graphs):
    segments, edges, queries = small_graphs
    cost = Penalties(3, 2, 1)
    by_path = {(r.graph_id, r.query_id): r.score for r in affine_graph_align(queries, segments, edges, cost).collect()}
    for method in ("table", "wavefront", "levels"):
        found = affine_graph_cost(queries.filter("pattern is not null"), segments, edges, cost, method).collect()
        assert {(r.graph_id, r.query_id): r.cost for r in found} == by_path


def test_affine_scripts_of_odd_pairs(spark):
    made = [("ACGT", "AGGGT"), ("", ""), ("", "AC"), ("AC", ""), (None, "A"), ("A", None), ("é", "e")]
    table = spark.createDataFrame(made, "a string, b string").withColumn("al", affine_align(F.col("a"), F.col("b"), unit="char"))
    for r in table.collect():
        if r.a is None or r.b is None:
            assert r.al.cost is None and r.al.ops is None
        else:
            replay(r.a, r.b, r.al.ops)
            assert r.al.cost == gap_affine(r.a, r.b, 4, 6, 2)


def test_long_score_tables_leave_in_pieces(spark):
    rng = random.Random(34)
    a, b = ("".join(rng.choices("ACGT", k=n)) for n in (1500, 1200))
    table = score_rows(spark.createDataFrame([(1, a, b), (2, "", "A"), (3, None, "A")], "id long, a string, b string"), "a", "b")
    assert table.columns == ["id", "h", "v", "score"] and table.count() == 1501 * 1201 + 2
    assert table.filter("id = 1 and h = 1200 and v = 1500").first().score == levenshtein(a, b)


def test_graph_files(spark, tmp_path):
    nodes = spark.createDataFrame([(g, v, "ACGT"[v % 4], []) for g in range(5) for v in range(4)], "graph_id long, node_id long, symbol string, aligned array<long>")
    edges = spark.createDataFrame([(g, v, v + 1, 1, v) for g in range(5) for v in range(3)], EDGES)
    paths = nodes.select("graph_id", F.lit(0).alias("seq_rank"), "node_id")
    lines = export.gfa_lines(nodes.withColumnRenamed("symbol", "sequence"), edges, paths, ranking.ranks(nodes, edges))
    want = {}
    for r in lines.orderBy("graph_id", *[k for k in export.KEYS if k != "graph_id"]).collect():
        want.setdefault(r.graph_id, []).append(r.line)
    spark.dataSource.register(GraphFiles)
    for mode, times in (("append", 1), ("append", 2), ("overwrite", 1)):
        in_line_order(lines).write.format("graph_files").mode(mode).save(str(tmp_path / "out"))
        names = glob.glob(f"{tmp_path}/out/part-*/*.gfa")
        assert len(names) == 5 * times and not glob.glob(f"{tmp_path}/out/_staged*")
        for name in names:
            with open(name) as file:
                assert file.read().splitlines() == want[int(name.rsplit("/", 1)[1].removesuffix(".gfa"))]
    # a task that is lost after it wrote leaves nothing behind, nor does a write that fails
    writer = GraphFilesWriter(str(tmp_path / "lost"), ".gfa", False)
    rows = [type("R", (), {"graph_id": 1, "line": "H"})()]
    writer.write(iter(rows))
    kept = writer.write(iter(rows))
    writer.commit([kept, Written(None), None])
    assert len(glob.glob(f"{tmp_path}/lost/part-*/1.gfa")) == 1 and not glob.glob(f"{tmp_path}/lost/_staged*")
    writer = GraphFilesWriter(str(tmp_path / "failed"), ".gfa", False)
    writer.write(iter(rows))
    writer.abort([])
    assert not glob.glob(f"{tmp_path}/failed/*")


def test_isolated_nodes_and_sources(spark, small_graphs):
    segments, edges, _ = small_graphs
    nodes = segments.withColumnRenamed("segment_id", "node_id")
    assert seg.sources(nodes, edges).count() >= 12


def test_a_batch_reads_only_nodes_it_meets():
    """Whatever was laid before, one more sequence reads the aligned sets it points to, and gives the same path."""
    from seqloom.streaming.growth import ListedNodes, StoredNodes, thread

    class Store(dict):
        reads = writes = 0

        def getValue(self, key):  # noqa: N802
            self.reads += 1
            return self[key]

        def updateValue(self, key, value):  # noqa: N802
            self.writes += 1
            self[key] = value

    rng = random.Random(35)
    store, size, listed, touched = Store(), 0, ListedNodes([], []), []
    for rank in range(40):
        seq = "".join(rng.choices("ACGT", k=30))
        pairs = [{"pos": i, "node": i} for i in range(30)] if rank else None
        nodes, before = StoredNodes(store, size), store.reads + store.writes
        assert thread(seq, pairs, nodes) == thread(seq, pairs, listed)
        nodes.save()
        size = nodes.size
        touched.append(store.reads + store.writes - before)
    assert size == len(listed.symbols) and max(touched) <= 30 * 4 * 2 and touched[-1] <= 30 * 4
    assert all((s, a) == store[i,] for i, (s, a) in enumerate(zip(listed.symbols, listed.aligned)))


def test_fold_over_short_and_long_rows(spark, monkeypatch):
    from seqloom.functions import text

    rng = random.Random(36)
    made = [("".join(rng.choices("abc", k=rng.randint(0, 12))), "".join(rng.choices("abc", k=rng.randint(0, 12)))) for _ in range(60)]
    table = spark.createDataFrame(made, "a string, b string")
    for limit in (512, 0):
        monkeypatch.setattr(text, "SHORT_ROW", limit)
        found = table.select("a", "b", text.distance_by_fold(F.col("a"), F.col("b")).alias("d")).collect()
        assert all(r.d == levenshtein(r.a, r.b) for r in found)
