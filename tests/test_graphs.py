import random

import pytest
from brute import gap_affine, levenshtein
from pyspark.sql import functions as F

from seqloom.kernels import orders
from seqloom.operators.affine import affine_graph_cost
from seqloom.operators import by_level, checks, export, graph_align, msa, ranking, segments as seg
from seqloom.operators.pograph import grown_graph, po_graph, star_graph
from seqloom.sources.fixtures import example_graph, po_sequences

SEQUENCES = "graph_id long, seq_rank int, seq string, pairs array<struct<node:int,pos:int>>"
NODES = "graph_id long, node_id long"
EDGES = "graph_id long, src long, dst long, weight long, ord int"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def po(spark):
    return po_graph(po_sequences(spark))


def test_po_example_nodes_and_edges(po):
    assert rows(po.nodes.filter("node_id > 8"), "node_id", "symbol", "aligned") == [
        (9, "C", [1]), (10, "T", [6]), (11, "C", [8]),
    ]
    assert rows(po.edges(), "src", "dst", "weight") == [
        (0, 1, 2), (0, 9, 4), (1, 2, 2), (2, 3, 4), (3, 4, 4), (4, 5, 6), (5, 6, 4), (5, 10, 2),
        (6, 7, 2), (6, 8, 2), (7, 8, 2), (9, 2, 2), (9, 4, 2), (10, 11, 2),
    ]


def test_po_example_rank_msa_and_consensus(po):
    edges = po.edges()
    ranks = ranking.ranks(po.nodes, edges)
    order = [r.node_id for r in ranks.orderBy("rank").collect()]
    assert order == [0, 1, 9, 2, 3, 4, 5, 6, 10, 7, 8, 11]
    path = ranking.consensus(po.nodes, edges)
    assert [r.node_id for r in path.orderBy("pos").collect()] == [0, 9, 2, 3, 4, 5, 6, 7, 8]
    every = po.paths.select("graph_id", "seq_rank", "node_id").unionByName(
        path.select("graph_id", F.lit(9).alias("seq_rank"), "node_id")
    )
    drawn = msa.rows(every, po.nodes, msa.columns(po.nodes, ranks))
    assert [r[1] for r in rows(drawn, "seq_rank", "row")] == ["CAAATAAGT", "CCAATAA-T", "CC--TAT-C", "CCAATAAGT"]


def test_identity_aligned_set_settles_ties(spark):
    same = [(i, i) for i in range(7)]
    sequences = spark.createDataFrame(
        [(1, 0, "TGAAACAT", None), (1, 1, "CGTTTCC", same), (1, 2, "AGTGTCC", same)], SEQUENCES
    )
    graph = star_graph(sequences)
    edges = graph.edges()
    placed = msa.columns(graph.nodes, ranking.ranks(graph.nodes, edges))
    path = ranking.consensus(graph.nodes, edges).select("graph_id", F.lit(9).alias("seq_rank"), "node_id")
    every = graph.paths.select("graph_id", "seq_rank", "node_id").unionByName(path)
    drawn = rows(msa.rows(every, graph.nodes, placed), "seq_rank", "row")
    assert [r[1] for r in drawn] == ["TGAAACAT", "CGTTTCC-", "AGTGTCC-", "AGTGTCC-"]


def random_star_sequences(spark, graphs=12, seed=7):
    """Sequences with gapped alignments to the first one; prefixes and suffixes unaligned."""
    rng, out = random.Random(seed), []
    for g in range(graphs):
        first = "".join(rng.choices("ACGT", k=rng.randint(1, 8)))
        out.append((g, 0, first, None))
        for s in range(1, rng.randint(1, 5)):
            seq = "".join(rng.choices("ACGT", k=rng.randint(1, 8)))
            low = rng.randint(0, len(seq) - 1)
            pairs, node = [], 0
            for pos in range(low, rng.randint(low + 1, len(seq))):
                node += rng.randint(0, 2)
                pairs.append((node if node < len(first) and rng.random() < 0.8 else None, pos))
                node += 1
            out.append((g, s, seq, pairs if rng.random() < 0.9 else None))
    return spark.createDataFrame(out, SEQUENCES)


def test_star_and_round_by_round_growth_build_the_same_graph(spark):
    sequences = random_star_sequences(spark)
    one, other = star_graph(sequences), grown_graph(sequences)
    assert rows(one.nodes, "graph_id", "node_id", "symbol", "aligned") == rows(
        other.nodes, "graph_id", "node_id", "symbol", "aligned")
    assert rows(one.edges(), "*") == rows(other.edges(), "*")
    assert rows(one.starts(), "*") == rows(other.starts(), "*")


def test_weights_and_single_symbol_prefix(spark):
    sequences = spark.createDataFrame(
        [(1, 0, "AC", None, [1, 2]), (1, 1, "GAC", [(0, 1), (1, 2)], [5, 1, 1]), (1, 2, "", None, None)],
        SEQUENCES + ", weights array<int>",
    )
    graph = po_graph(sequences)
    # the unaligned G gets its own node and the edge to the first aligned base
    assert rows(graph.edges(), "src", "dst", "weight") == [(0, 1, 3 + 2), (2, 0, 6)]
    assert rows(graph.starts(), "seq_rank", "node_id") == [(0, 0), (1, 2)]


@pytest.mark.parametrize("number, text", [(1, "ACTGTACT"), (2, "AAAGGGAAA"), (3, "AG")])
def test_example_consensus(spark, number, text):
    segments, edge_rows, _ = example_graph(spark, number)
    nodes = segments.withColumnRenamed("segment_id", "node_id")
    path = ranking.consensus(nodes, seg.merge_edges(edge_rows), "newest")
    assert export.consensus_text(path, nodes, "sequence").first().consensus == text


def test_example_gfa(spark, tmp_path):
    segments, edge_rows, paths = example_graph(spark, 1)
    nodes, edges = segments.withColumnRenamed("segment_id", "node_id"), seg.merge_edges(edge_rows)
    ranks = ranking.ranks(nodes, edges, "newest")
    lines = export.gfa_lines(nodes, edges, paths, ranks, ranking.consensus(nodes, edges, "newest"))
    want = [
        "H\tVN:Z:1.0\tNS:i:4\tNL:i:4\tNP:i:3", "S\t1\tACT", "S\t3\tGT", "L\t1\t+\t3\t+\t0M", "S\t2\tACCTG",
        "L\t1\t+\t2\t+\t0M", "S\t4\tACT", "L\t2\t+\t4\t+\t0M", "L\t3\t+\t4\t+\t0M", "P\t0\t1+,2+,4+\t*",
        "P\t1\t1+,3+,4+\t*", "P\tConsensus_sequence\t1+,3+,4+\t*",
    ]
    assert [r.line for r in lines.orderBy(*export.KEYS).collect()] == want
    export.write_lines(lines, str(tmp_path / "gfa"))
    parts = sorted((tmp_path / "gfa").glob("part-*"))
    assert "".join(p.read_text() for p in parts).splitlines() == want


def test_dot_draws_every_node_edge_and_aligned_set(po):
    ranks = ranking.ranks(po.nodes, po.edges())
    lines = [r.line for r in export.dot_lines(po.nodes, po.edge_rows(), ranks).orderBy(*export.KEYS).collect()]
    assert lines[2] == "digraph po_graph {" and lines[-1] == "}"
    assert sum(" -> " in x and "penwidth" in x for x in lines) == 14
    assert sum("rank=same" in x for x in lines) == 6 and sum("dashed" in x for x in lines) == 3


# Queries with known distances to the first example graph.
GOLDEN = [("ACTGTACT", 0), ("AGTGGAGT", 3), ("ACGTAT", 2), ("GT", 6), ("CTACGAC", 4), ("", 8)]


@pytest.mark.parametrize("method", ["table", "wavefront", "levels"])
def test_example_alignment(spark, method):
    segments, edge_rows, _ = example_graph(spark, 1)
    queries = spark.createDataFrame(
        [(1, i, q) for i, (q, _) in enumerate(GOLDEN)], "graph_id long, query_id long, pattern string"
    )
    found = graph_align.align_graphs(queries, segments, seg.merge_edges(edge_rows), method)
    assert [r[1] for r in rows(found, "query_id", "score")] == [score for _, score in GOLDEN]
    assert rows(found.filter("query_id = 2"), "cigar") == [("(1)2M1I(3)2M(4)1M1I1M",)]


def test_affine_cost_of_large_graphs(spark):
    segments, edge_rows, _ = example_graph(spark, 1)
    queries = spark.createDataFrame(
        [(1, i, q) for i, (q, _) in enumerate(GOLDEN)], "graph_id long, query_id long, pattern string"
    )
    edges = seg.merge_edges(edge_rows)
    routes = ["ACTACCTGACT", "ACTGTACT"]
    want = [(i, min(gap_affine(q, r, 4, 6, 2) for r in routes)) for i, (q, _) in enumerate(GOLDEN)]
    for method in ("table", "wavefront", "levels"):
        found = affine_graph_cost(queries, segments, edges, method=method)
        assert rows(found, "query_id", "cost") == want


def test_more_than_ten_segments_keep_their_ids(spark):
    segments = spark.createDataFrame(
        [(1, i, c) for i, c in enumerate("ACGTACGTACGT")], "graph_id long, segment_id long, sequence string"
    )
    edges = spark.createDataFrame([(1, i, i + 1, 1, i) for i in range(11)], EDGES)
    queries = spark.createDataFrame([(1, 0, "ACGTACGTACG")], "graph_id long, query_id long, pattern string")
    row = graph_align.align_graphs(queries, segments, edges, "wavefront").first()
    assert row.score == 1 == levenshtein("ACGTACGTACG", "ACGTACGTACGT")
    assert [s.segment for s in row.path] == list(range(12))


def random_dags(rng, graphs=6):
    nodes, edges = [], []
    for g in range(graphs):
        count, ord_ = rng.randint(2, 8), 0
        nodes += [(g, v) for v in range(count)]
        for v in range(count):
            for u in rng.sample(range(v), rng.randint(0, min(v, 3))):
                edges.append((g, u, v, rng.randint(1, 4), ord_))
                ord_ += 1
    return nodes, edges


def test_large_graph_consensus_follows_the_same_rules(spark):
    nodes, edges = random_dags(random.Random(21))
    node_df, edge_df = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    scores, path = by_level.heaviest_by_level(node_df, edge_df)
    level = {(r.graph_id, r.node_id): r.level for r in seg.levels(node_df, edge_df).collect()}
    want_scores, want_paths = [], []
    for g in {g for g, _ in nodes}:
        count = sum(n[0] == g for n in nodes)
        preds, succs, weights = orders.neighbours(count, [e[1:4] for e in edges if e[0] == g])
        order = sorted(range(count), key=lambda v: (level[g, v], v))
        found, best = orders.heaviest_path(order, preds, succs, weights)
        want_scores += [(g, v, s) for v, s in enumerate(found)]
        want_paths += [(g, i, v) for i, v in enumerate(best)]
    assert rows(scores, "graph_id", "node_id", "score") == sorted(want_scores)
    assert rows(path, "graph_id", "pos", "node_id") == sorted(want_paths)


def test_large_graph_ranks_are_valid_for_msa(spark, po):
    edges = po.edges()
    ranks = ranking.ranks(po.nodes, edges, "level")
    assert seg.rank_violations(edges, ranks).count() == 0
    drawn = msa.rows(po.paths, po.nodes, msa.columns(po.nodes, ranks))
    stripped = drawn.select("seq_rank", F.replace("row", F.lit("-"), F.lit("")).alias("seq"))
    assert rows(stripped, "seq_rank", "seq") == [(0, "CAAATAAGT"), (1, "CCAATAAT"), (2, "CCTATC")]


def test_order_decides_the_consensus_not_the_size(spark):
    """A tie for the best node: the first in the order asked for ends the bundle."""
    nodes = spark.createDataFrame([(g, v) for g in (1, 2) for v in range(4 if g == 1 else 2004)], NODES)
    edges = [(g, 0, 2, 2, 0) for g in (1, 2)] + [(g, 2, 1, 2, 1) for g in (1, 2)] + [(g, 0, 3, 4, 2) for g in (1, 2)]
    edges = spark.createDataFrame(edges, EDGES)
    for order in ("newest", "depth"):
        found = rows(ranking.consensus(nodes, edges, order), "graph_id", "pos", "node_id")
        assert [r[1:] for r in found if r[0] == 1] == [r[1:] for r in found if r[0] == 2]
    assert rows(ranking.consensus(nodes, edges).filter("graph_id = 1"), "pos", "node_id") == [(0, 0), (1, 2), (2, 1)]
    diamond = spark.createDataFrame([(1, v) for v in range(5)], NODES)
    links = spark.createDataFrame([(1, 0, 1, 1, 0), (1, 0, 2, 1, 1), (1, 1, 3, 1, 2), (1, 2, 3, 1, 3), (1, 3, 4, 1, 4)], EDGES)
    assert [r[1] for r in rows(ranking.ranks(diamond, links, "newest"), "rank", "node_id")] == [0, 2, 1, 3, 4]


def test_deep_graph_is_walked_in_linear_time(spark):
    """One graph of 200,000 nodes and depth 100,000, with a bubble at every step."""
    steps = spark.range(100_000)
    nodes = spark.range(200_001).select(F.lit(1).alias("graph_id"), F.col("id").alias("node_id"))
    way = lambda a, b, w, o: F.struct((2 * F.col("id") + a).alias("src"), (2 * F.col("id") + b).alias("dst"), F.lit(w).alias("weight"), (3 * F.col("id") + o).alias("ord"))
    edges = steps.select(F.lit(1).alias("graph_id"), F.explode(F.array(way(0, 1, 1, 0), way(1, 2, 1, 1), way(0, 2, 5, 2))).alias("e")).select("graph_id", "e.*")
    ranks = ranking.ranks(nodes, edges, "depth")
    assert seg.rank_violations(edges, ranks).count() == 0 and ranks.count() == 200_001
    path = ranking.consensus(nodes, edges)
    assert path.agg(F.count("*"), F.max("node_id"), F.sum(F.col("node_id") % 2)).first() == (100_001, 200_000, 0)


def test_ranks_that_are_missing_are_violations(spark):
    edges = spark.createDataFrame([(1, 0, 1, 1, 0), (1, 1, 2, 1, 1)], EDGES)
    none = spark.createDataFrame([], "graph_id long, rank int, node_id long")
    assert seg.rank_violations(edges, none).count() == 2


def test_degrees_of_nodes_without_edges(spark):
    nodes = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], NODES)
    edges = spark.createDataFrame([(1, 0, 1, 1, 0)], EDGES)
    assert rows(seg.degrees(nodes, edges), "node_id", "in_degree", "out_degree") == [(0, 0, 1), (1, 1, 0), (2, 0, 0)]


def test_levels_refuse_cycles(spark):
    nodes = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], NODES)
    edges = spark.createDataFrame([(1, 0, 1, 1, 0), (1, 1, 2, 1, 1), (1, 2, 1, 1, 2)], EDGES)
    with pytest.raises(orders.CyclicGraph):
        seg.levels(nodes, edges)


def test_alignment_problems_are_named(spark):
    sequences = spark.createDataFrame(
        [
            (1, 0, "ACGT", None, None), (1, 1, "ACG", [(0, None)], None), (1, 2, "ACG", [(0, 3)], None),
            (1, 3, "ACG", [(0, 0), (1, 2)], None), (1, 4, "ACG", [(0, 0), (2, None), (3, 1)], [1, 1]),
            (1, 5, "ACG", [(0, 1), (None, 2)], [1, 1, 1]),
        ],
        SEQUENCES + ", weights array<int>",
    )
    found = rows(checks.alignment_problems(sequences), "seq_rank", "problem")
    assert [rank for rank, _ in found] == [1, 2, 3, 4] and len({text for _, text in found}) == 4


def test_dangling_edges(spark):
    nodes = spark.createDataFrame([(1, 0), (1, 1)], NODES)
    edges = spark.createDataFrame([(1, 0, 1, 1, 0), (1, 1, 2, 1, 1), (2, 0, 1, 1, 0)], EDGES)
    assert rows(checks.dangling_edges(nodes, edges), "graph_id", "dst") == [(1, 2), (2, 1)]


def test_unitigs_compact_chains_and_keep_edges(po):
    members, compact = seg.unitigs(po.nodes, po.edges())
    assert rows(compact.filter("length > 1"), "unitig_id", "sequence") == [(2, "AA"), (4, "TA"), (10, "TC")]
    assert seg.compacted_edges(members, po.edges()).count() == 14 - 3
