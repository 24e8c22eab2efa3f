"""Graphs that are a row each give what graphs of rows give, without a shuffle."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import export, msa, ranking, segments as seg, whole
from seqloom.operators.aligned_growth import aligned_growth
from seqloom.operators.pograph import star_graph
from seqloom.sources.graphs import text_sequences


def made(spark, turns):
    table = spark.createDataFrame(turns, "conv_id long, turn int, text string")
    both = text_sequences(table, "conv_id", "turn")
    return star_graph(both.drop("runs")), star_graph(both.drop("pairs"))


@pytest.fixture(scope="module")
def graphs(spark):
    rng = random.Random(81)
    turns = [(g, t, "".join(rng.choices("ACGé😀-", k=rng.randint(1, 14)))) for g in range(40) for t in range(3, 3 + rng.randint(1, 7))]
    return made(spark, [*turns, (50, 1, "A"), (None, 1, "AC"), (51, 2, ""), (52, 1, "AB" * 30), (52, 2, "BA" * 70)])


def rows(table):
    return sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in table.select(*sorted(table.columns)).collect()), key=repr)


def test_nodes_paths_and_edges(graphs):
    one, other = graphs
    assert whole.shared(nodes=other.nodes, paths=other.paths) and not whole.shared(nodes=one.nodes)
    for table in ("nodes", "paths"):
        assert rows(getattr(one, table)) == rows(getattr(other, table))
        assert dict(getattr(one, table).dtypes) == dict(getattr(other, table).dtypes)
    assert rows(one.edges()) == rows(other.edges()) and rows(one.edges()) == rows(other.written().edges())
    assert dict(one.edges().dtypes) == dict(other.edges().dtypes)


def test_turns_that_come_twice_or_without_a_number(spark):
    turns = [(1, 1, "ACA"), (1, 2, "AGA"), (1, 2, "AGA"), (2, None, "AC"), (2, None, "AG"), (2, 4, "CA"), (3, None, "A"), (4, 2, "AC"), (4, 1, "A")]
    one, other = made(spark, turns)
    assert rows(one.paths) == rows(other.paths) and rows(one.edges()) == rows(other.edges())
    sets = lambda g: rows(g.nodes.select("graph_id", "symbol", F.size("aligned").alias("peers")))
    assert sets(one) == sets(other)


def test_orders_consensus_and_checks(graphs):
    found = []
    for graph in graphs:
        edges = graph.edges()
        ranks, path = ranking.ranks_and_consensus(graph.nodes, edges)
        backwards = ranks.withColumn("rank", -F.col("rank"))
        found.append([
            ranks, path, ranking.ranks(graph.nodes, edges, "newest"), ranking.consensus(graph.nodes, edges),
            seg.sources(graph.nodes, edges), seg.sinks(graph.nodes, edges), seg.jumps(path, edges),
            seg.among(path, seg.sources(graph.nodes, edges)), seg.among(path, seg.sinks(graph.nodes, edges)),
            seg.rank_violations(edges, ranks), seg.rank_violations(edges, backwards),
        ])
    for i, (one, other) in enumerate(zip(*found, strict=True)):
        assert rows(one) == rows(other), i
        assert dict(one.dtypes) == dict(other.dtypes), i


def test_rows_of_the_alignment(graphs):
    found = []
    for graph in graphs:
        ranks = ranking.ranks(graph.nodes, graph.edges())
        columns = msa.columns(graph.nodes, ranks)
        found.append((columns, msa.rows(graph.paths, graph.nodes, columns)))
    for one, other in zip(*found, strict=True):
        assert rows(one) == rows(other) and dict(one.dtypes) == dict(other.dtypes)


def test_gfa_lines(graphs):
    for with_path in (True, False):
        found = []
        for graph in graphs:
            ranks, path = ranking.ranks_and_consensus(graph.nodes, graph.edges())
            segments = whole.renamed(graph.nodes, "symbol", "sequence")
            found.append(export.gfa_lines(segments, graph.edges(), graph.paths, ranks, path if with_path else None))
        assert rows(found[0]) == rows(found[1]) and found[0].columns == found[1].columns


def test_written_graphs_are_not_moved(graphs, capsys):
    graph = graphs[1].written()
    edges = whole.kept(graph.edges(), "edges")
    ranks, path = ranking.ranks_and_consensus(graph.nodes, edges)
    lines = export.gfa_lines(whole.renamed(graph.nodes, "symbol", "sequence"), edges, graph.paths, ranks, path)
    for table in (ranks, lines, seg.rank_violations(edges, ranks), msa.rows(graph.paths, graph.nodes, msa.columns(graph.nodes, ranks))):
        capsys.readouterr()
        table.explain()
        assert "Exchange" not in capsys.readouterr().out


def test_graphs_without_nodes_have_no_rows_but_scores(spark):
    rows_ = [(1, 0, ""), (1, 1, None), (2, 0, "AC"), (2, 1, "AG")]
    graph, scores = aligned_growth(spark.createDataFrame(rows_, "graph_id long, seq_rank long, seq string"))
    assert rows(scores) == [(1, 0, 0), (1, 0, 1), (2, 1, 1), (2, 2, 0)]
    ranks, path = ranking.ranks_and_consensus(graph.nodes, graph.edges())
    assert {r.graph_id for r in ranks.collect()} == {r.graph_id for r in path.collect()} == {2}
    spelled = [tuple(r) for r in seg.spelled_paths(graph.paths, graph.nodes, ranks).orderBy("seq_rank").collect()]
    assert spelled == [(2, 0, "AC", 0), (2, 1, "AG", 0)]


def test_spelled_paths(graphs):
    found = []
    for graph in graphs:
        ranks = ranking.ranks(graph.nodes, graph.edges())
        found.append(seg.spelled_paths(graph.paths, graph.nodes, ranks))
    assert rows(found[0]) == rows(found[1]) and found[0].dtypes == found[1].dtypes
