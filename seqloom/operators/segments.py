"""Segment and node graphs as rows, for any number of graphs of any size.

nodes : graph_id, node_id, ...          edges : graph_id, src, dst, weight, ord
``ord`` is the insertion order of an edge; it settles ties. Nothing here gathers a graph.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from seqloom.kernels.orders import CyclicGraph
from seqloom.kernels.whole import Whole, text_of
from seqloom.operators import whole
from seqloom.session import materialise_graph


def merge_edges(rows: DataFrame) -> DataFrame:
    """Upsert: one edge per (src, dst) with the summed weight and its first ``ord``."""
    return rows.groupBy("graph_id", "src", "dst").agg(
        F.sum("weight").alias("weight"), F.min("ord").alias("ord")
    )


def label_arrays(rows: DataFrame) -> DataFrame:
    """The labels of each edge as a sorted array, for graphs of few sequences.

    Keep the labelled rows themselves where an edge may carry very many sequences.
    """
    return rows.groupBy("graph_id", "src", "dst").agg(
        F.array_sort(F.collect_list("label")).alias("labels")
    )


def successors(rows: DataFrame, label: int) -> DataFrame:
    """node -> next node on the path of one sequence."""
    return rows.filter(F.col("label") == label).select(
        "graph_id", F.col("src").alias("node_id"), F.col("dst").alias("next_id")
    )


#: Views of the nodes that no edge has at this end.
ENDS = {"src": "sinks", "dst": "sources"}
_SIDE = {"sinks": 0, "sources": 1}


def _without(nodes: DataFrame, edges: DataFrame, end: str) -> DataFrame:
    graphs = whole.shared(nodes=nodes, edges=edges)
    if graphs is not None:

        def listed(g: Whole) -> list:
            at = np.flatnonzero(g.is_end(_SIDE[ENDS[end]]))
            return [at, *(column.take(at) for column in (whole.letters(g), whole.aligned(g)))]

        return graphs.view(ENDS[end], graphs.rows(whole.NODE, listed))
    ends = edges.select("graph_id", F.col(end).alias("node_id"))
    return nodes.join(ends, ["graph_id", "node_id"], "left_anti")


def sources(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _without(nodes, edges, "dst")


def sinks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _without(nodes, edges, "src")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, node_id, in_degree, out_degree of all nodes, 0 without edges; one shuffle."""
    ends = F.explode(
        F.array(
            F.struct(F.col("dst").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
            F.struct(F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        )
    )
    alone = nodes.select("graph_id", "node_id", F.lit(0).alias("i"), F.lit(0).alias("o"))
    return (
        edges.select("graph_id", ends.alias("end"))
        .select("graph_id", "end.*")
        .unionByName(alone)
        .groupBy("graph_id", "node_id")
        .agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    )


def link_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("graph_id").agg(F.count("*").alias("links"))


def spelling(nodes: DataFrame, ranks: DataFrame, text: str = "symbol") -> DataFrame:
    """The graph as a string: node texts in rank order."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", text)))
    return (
        nodes.join(ranks, ["graph_id", "node_id"])
        .groupBy("graph_id")
        .agg(F.array_join(F.transform(ordered, lambda e: e[text]), "").alias("spelling"))
    )


def rank_violations(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """Edges whose source does not come before their destination, or that lack a rank.

    Empty = sorted, and every edge was looked at.
    """
    graphs = whole.shared(edges=edges, ranks=ranks)
    if graphs is not None:

        def broken(g: Whole) -> list:
            src, dst, weight, first = g.edges
            rank = g.rank_of(g.made["order"])
            a, b = rank[src], rank[dst]
            at = np.flatnonzero((a < 0) | (b < 0) | (a >= b))
            return [dst[at], src[at], weight[at], whole.ranked(first[at]), *(whole.known(x[at]) for x in (a, b))]

        fields = [T.StructField(c, T.LongType()) for c in ("dst", "src", "weight")]
        return graphs.rows([*fields, *(T.StructField(c, T.IntegerType()) for c in ("ord", "rank_src", "rank_dst"))], broken)
    at = lambda end, name: ranks.select(
        "graph_id", F.col("node_id").alias(end), F.col("rank").alias(name)
    )
    return (
        edges.join(at("src", "rank_src"), ["graph_id", "src"], "left")
        .join(at("dst", "rank_dst"), ["graph_id", "dst"], "left")
        .filter("rank_src is null or rank_dst is null or rank_src >= rank_dst")
    )


def jumps(path: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps of paths (graph_id, pos, node_id) that are no edges: graph_id, src, dst, pos."""
    graphs = whole.shared(consensus=path, edges=edges)
    if graphs is not None:

        def missing(g: Whole) -> list:
            on = np.asarray(g.made["consensus"], np.int64)
            src, dst, *_ = g.edges
            at = np.flatnonzero(~np.isin(on[:-1] * g.size + on[1:], src * g.size + dst))
            return [on[at], on[at + 1], at]

        return graphs.rows([T.StructField(c, T.LongType()) for c in ("src", "dst")] + [T.StructField("pos", T.IntegerType())], missing)
    following = path.select("graph_id", (F.col("pos") - 1).alias("pos"), F.col("node_id").alias("dst"))
    steps = path.withColumnRenamed("node_id", "src").join(following, ["graph_id", "pos"])
    return steps.join(edges, ["graph_id", "src", "dst"], "left_anti").select("graph_id", "src", "dst", "pos")


def spelled_paths(paths: DataFrame, nodes: DataFrame, ranks: DataFrame) -> DataFrame:
    """graph_id, seq_rank, text, late: what each sequence's path spells, and its steps that do not lead forward in the order."""
    graphs = whole.shared(paths=paths, nodes=nodes, ranks=ranks)
    if graphs is not None:

        def spelled_out(g: Whole) -> list:
            own, pos, node, _ = g.places
            at, symbol = g.rank_of(g.made["order"])[node], g.symbols[node]
            named, sizes = g.runs_of_ranks()
            if len(named) < len(g.ranks):  # of one rank, they come by place, symbol and rank
                order = np.lexsort((at, symbol, pos, own))
                at, symbol = at[order], symbol[order]
            ends = np.cumsum(sizes)
            texts = [text_of(symbol[low:high]) for low, high in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
            back = np.append(at[1:] <= at[:-1], False)
            back[ends - 1] = False
            return [whole.ranked(named), texts, np.add.reduceat(back, ends - sizes, dtype=np.int64)]

        return graphs.rows(
            [T.StructField("seq_rank", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("late", T.LongType())], spelled_out
        )
    placed = paths.join(nodes, ["graph_id", "node_id"]).join(ranks, ["graph_id", "node_id"])
    listed = F.array_sort(F.collect_list(F.struct("pos", "symbol", "rank")))
    spelled = placed.groupBy("graph_id", "seq_rank").agg(listed.alias("s"))
    late = F.size(F.filter(F.arrays_zip(F.slice("s.rank", 2, F.size("s")), F.slice("s.rank", 1, F.size("s") - 1)), lambda p: p["0"] <= p["1"]))
    return spelled.select("graph_id", "seq_rank", F.array_join("s.symbol", "").alias("text"), late.cast("long").alias("late"))


def among(path: DataFrame, ends: DataFrame) -> DataFrame:
    """Places of paths (graph_id, pos, node_id) at nodes that are sources or sinks."""
    for kind, side in _SIDE.items():
        graphs = whole.shared(**{"consensus": path, kind: ends})
        if graphs is not None:

            def met(g: Whole, side=side) -> list:
                at = np.flatnonzero(g.is_end(side)[g.made["consensus"]])
                return [at, np.asarray(g.made["consensus"], np.int64)[at]]

            return graphs.rows([T.StructField("pos", T.IntegerType()), T.StructField("node_id", T.LongType())], met)
    return path.join(ends.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_semi").select("graph_id", "pos", "node_id")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, node_id, level: the longest path from a source, peeled level by level.

    Ordering by (level, node_id) is a topological order. Each round touches only edges not
    yet peeled, all graphs advance together, and no graph has to fit anywhere. Rounds =
    longest path, so compact chains first (``unitigs``) when graphs are deep.
    """
    left = materialise_graph(edges.select("graph_id", "src", "dst").distinct(), "peel")
    front = materialise_graph(
        sources(nodes.select("graph_id", "node_id"), left).withColumn("level", F.lit(0)), "level"
    )
    done = front
    level = 0
    while not left.isEmpty():
        if front.isEmpty():
            raise CyclicGraph("edges remain that no source leads to")
        level += 1
        gone = front.select("graph_id", F.col("node_id").alias("src"))
        freed = left.join(gone, ["graph_id", "src"], "left_semi")
        kept = materialise_graph(left.join(gone, ["graph_id", "src"], "left_anti"), "peel")
        front = materialise_graph(
            sources(
                freed.select("graph_id", F.col("dst").alias("node_id")).distinct(), kept
            ).withColumn("level", F.lit(level)),
            "level",
        )
        done, left = done.unionByName(front), kept
    return done


def level_order(leveled: DataFrame) -> DataFrame:
    """Ranks from levels, also for graphs too large for one window."""
    from seqloom.operators.numbering import number_within

    return number_within(leveled, ["graph_id"], ["level", "node_id"], "rank")


def unitigs(nodes: DataFrame, edges: DataFrame, text: str = "symbol") -> tuple[DataFrame, DataFrame]:
    """Compact maximal unbranching chains.

    Returns (members: graph_id, node_id, unitig_id, offset; segments: graph_id, unitig_id,
    length, sequence). A node joins its predecessor's chain when the edge between them is
    the only way out of one and into the other. Chain heads are found by pointer doubling:
    the number of rounds is the logarithm of the longest chain, and each round only moves
    the nodes whose head is still open.
    """
    degree = degrees(nodes, edges)
    one_out = degree.filter("out_degree = 1").select("graph_id", F.col("node_id").alias("src"))
    one_in = degree.filter("in_degree = 1").select("graph_id", F.col("node_id").alias("dst"))
    inner = materialise_graph(
        edges.select("graph_id", "src", "dst")
        .join(one_out, ["graph_id", "src"], "left_semi")
        .join(one_in, ["graph_id", "dst"], "left_semi")
        .select("graph_id", F.col("dst").alias("node_id"), F.col("src").alias("head")),
        "inner",
    )
    # a chain is settled for a node once its head is a node no inner edge enters
    entered = inner.select("graph_id", F.col("node_id").alias("head"), F.lit(False).alias("settled"))
    linked = materialise_graph(
        inner.join(entered, ["graph_id", "head"], "left").select(
            "graph_id", "node_id", "head", F.lit(1).cast("long").alias("offset"),
            F.coalesce("settled", F.lit(True)).alias("settled"),
        ),
        "chain",
    )
    done, active = linked.filter("settled"), linked.filter("not settled")
    while not active.isEmpty():
        # unsettled nodes of a chain have different heads, so this join has no heavy key
        jump = done.unionByName(active).select(
            "graph_id",
            F.col("node_id").alias("head"),
            F.col("head").alias("far"),
            F.col("offset").alias("more"),
            "settled",
        )
        longer = materialise_graph(
            active.drop("settled").join(jump, ["graph_id", "head"]).select(
                "graph_id", "node_id", F.col("far").alias("head"),
                (F.col("offset") + F.col("more")).alias("offset"), "settled",
            ),
            "chain",
        )
        done, active = done.unionByName(longer.filter("settled")), longer.filter("not settled")
    chain = nodes.select("graph_id", "node_id", text).join(done, ["graph_id", "node_id"], "left").select(
        "graph_id", "node_id", text,
        F.coalesce("head", "node_id").alias("head"),
        F.coalesce("offset", F.lit(0)).alias("offset"),
    )
    members = chain.withColumnRenamed("head", "unitig_id")
    parts = F.array_sort(F.collect_list(F.struct("offset", text)))
    segments = members.groupBy("graph_id", "unitig_id").agg(
        F.count("*").alias("length"),
        F.array_join(F.transform(parts, lambda e: e[text]), "").alias("sequence"),
    )
    return members.drop(text), segments


def compacted_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between unitigs: those that leave one chain's end for another chain's head."""
    at = lambda end, name: members.select(
        "graph_id",
        F.col("node_id").alias(end),
        F.col("unitig_id").alias(name),
        F.col("offset").alias(f"{end}_offset"),
    )
    return (
        edges.join(at("src", "u"), ["graph_id", "src"])
        .join(at("dst", "v"), ["graph_id", "dst"])
        .filter("dst_offset = 0")
        .select("graph_id", F.col("u").alias("src"), F.col("v").alias("dst"), "weight", "ord")
    )
