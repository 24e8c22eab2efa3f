"""Partial-order graphs from sequences and their alignments.

sequences : graph_id, seq_rank, seq, pairs ARRAY<STRUCT<node, pos>> [, weights ARRAY<INT>]
``pairs`` aligns the sequence to nodes that earlier sequences created; null node or null
pos is a gap, null or empty pairs mean unaligned. Aligned positions must be consecutive.

A base takes the node of its symbol in the aligned set it points to, else it creates one.
New nodes are numbered in the order prefix, suffix, aligned part of each sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from seqloom.kernels import scripts
from seqloom.operators import whole
from seqloom.operators.numbering import number_within
from seqloom.operators.segments import merge_edges
from seqloom.session import kernel, materialise_graph

PREFIX, SUFFIX, ALIGNED = 0, 1, 2


@dataclass
class PoGraph:
    nodes: DataFrame  # graph_id, node_id, symbol, aligned ARRAY<BIGINT>
    paths: DataFrame  # graph_id, seq_rank, pos, node_id, weight
    steps: DataFrame | None = None  # edge_rows() as a written table

    @classmethod
    def of(cls, graphs: whole.Graphs) -> PoGraph:
        """Views of graphs that are a row each."""
        return cls(whole.nodes(graphs), whole.paths(graphs))

    def written(self) -> PoGraph:
        """The same graphs as written tables, for callers that use them more than once."""
        graphs = whole.shared(nodes=self.nodes, paths=self.paths)
        if graphs is not None:
            return PoGraph.of(graphs.written())
        paths = materialise_graph(self.paths, "paths")
        steps = materialise_graph(PoGraph(self.nodes, paths).edge_rows(), "steps")
        return PoGraph(materialise_graph(self.nodes, "nodes"), paths, steps)

    def starts(self) -> DataFrame:
        """graph_id, seq_rank, node_id of the first base of every sequence."""
        return self.paths.filter("pos = 0").select("graph_id", "seq_rank", "node_id")

    def edge_rows(self) -> DataFrame:
        """One row per step of a sequence: graph_id, src, dst, label, weight, ord.

        The label is the sequence; both bases contribute to the weight. A node is entered
        at most once per sequence, so the label also orders the edges of a node.
        """
        if self.steps is not None:
            return self.steps
        along = Window.partitionBy("graph_id", "seq_rank").orderBy("pos")
        return (
            self.paths.withColumn("src", F.lag("node_id").over(along))
            .withColumn("weight", F.col("weight") + F.lag("weight").over(along))
            .filter("src is not null")
            .select(
                "graph_id",
                "src",
                F.col("node_id").alias("dst"),
                F.col("seq_rank").alias("label"),
                "weight",
                F.col("seq_rank").alias("ord"),
            )
        )

    def edges(self) -> DataFrame:
        graphs = whole.shared(paths=self.paths)
        return merge_edges(self.edge_rows()) if graphs is None else whole.edges(graphs)


def bases(sequences: DataFrame) -> DataFrame:
    """One row per base with the node it points to; row-local, no shuffle."""
    placed = sequences.withColumn("__used", F.filter("pairs", lambda p: p["pos"].isNotNull()))
    first, last = F.expr("__used[0].pos"), F.expr("element_at(__used, -1).pos")
    aligned = F.coalesce(F.size("__used"), F.lit(0)) > 0
    weight = (
        (lambda i: F.get("weights", i)) if "weights" in sequences.columns else (lambda i: F.lit(1))
    )

    def base(symbol, i):
        return F.struct(
            symbol.alias("symbol"),
            F.when(aligned & i.between(first, last), F.get("__used", i - first)["node"])
            .cast("long")
            .alias("ref"),
            F.when(~aligned | (i < first), PREFIX)
            .when(i > last, SUFFIX)
            .otherwise(ALIGNED)
            .alias("region"),
            F.coalesce(weight(i), F.lit(1)).cast("long").alias("weight"),
        )

    letters = F.filter(F.split("seq", ""), lambda c: c != "")
    return placed.select(
        "graph_id", "seq_rank", F.posexplode(F.transform(letters, base)).alias("pos", "base")
    ).select("graph_id", "seq_rank", "pos", "base.*")


#: Rows of one key up to which a window numbers them; beyond, the same numbers by ranges.
WINDOW_ROWS = 1_000_000


def ordinal(df: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """0-based number within ``key``; ``df`` should be a written table.

    A window does it while every key fits one task; beyond that the range-partitioned
    numbering gives the same numbers.
    """
    largest = df.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    if largest > WINDOW_ROWS:
        return number_within(df, [key], order, out)
    window = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window).cast("long") - 1)


def po_graph(sequences: DataFrame) -> PoGraph:
    """Build all graphs, whatever nodes the alignments point to.

    Alignments that point only to the first sequence (a star, or position-wise alignment)
    need no rounds; other graphs are grown one sequence rank at a time.
    """
    pointed = F.array_max(F.transform("pairs", lambda p: p["node"]))
    per_graph = sequences.groupBy("graph_id").agg(
        F.max(pointed).alias("far"),
        F.max(F.when(F.col("seq_rank") == 0, F.length("seq"))).alias("first_length"),
    )
    chained = per_graph.filter("far >= coalesce(first_length, 0)").select("graph_id")
    if chained.isEmpty():
        return star_graph(sequences)
    chained = materialise_graph(chained, "chained")
    star = star_graph(sequences.join(chained, "graph_id", "left_anti"))
    grown = grown_graph(sequences.join(chained, "graph_id", "left_semi"))
    return PoGraph(star.nodes.unionByName(grown.nodes), star.paths.unionByName(grown.paths))


def star_graph(sequences: DataFrame) -> PoGraph:
    """Graphs whose alignments all point to nodes of the sequence with rank 0.

    The aligned set of a base is then known without looking at other sequences: the node
    it points to. Bases that point nowhere stand alone. All that is left is one
    pre-aggregated group-by for the nodes and one join to give bases their node.

    Sequences with ``runs`` in place of ``pairs`` make a row per graph (see ``whole``), each in
    one task: for graphs that fit there.
    """
    if "runs" in sequences.columns:
        return PoGraph.of(whole.star_graphs(sequences))
    alone = F.when(F.col("seq_rank") == 0, F.col("pos").cast("long")).otherwise(
        -1 - F.shiftleft(F.col("seq_rank").cast("long"), 32) - F.col("pos")
    )
    grouped = bases(sequences).withColumn("set", F.coalesce("ref", alone))
    key = ["graph_id", "set", "symbol"]
    made = materialise_graph(
        grouped.groupBy(*key)
        .agg(F.min(F.struct("seq_rank", "region", "pos")).alias("made"))
        .select(*key, "made.*"),
        "nodes",
    )
    numbered = ordinal(made, "graph_id", ["seq_rank", "region", "pos"], "node_id").select(
        *key, "node_id"
    )
    paths = grouped.join(numbered, key).select("graph_id", "seq_rank", "pos", "node_id", "weight")
    # a set has one member per distinct symbol; the first is the node of sequence 0
    member = F.col("members.node_id")
    later = F.expr("slice(members.node_id, 2, size(members))")
    aligned = lambda m: F.when(m["node_id"] == member[0], later).otherwise(
        F.concat(
            F.filter(later, lambda o: o < m["node_id"]),
            F.slice(member, 1, 1),
            F.filter(later, lambda o: o > m["node_id"]),
        )
    )
    nodes = (
        numbered.groupBy("graph_id", "set")
        .agg(F.array_sort(F.collect_list(F.struct("node_id", "symbol"))).alias("members"))
        .select(
            "graph_id",
            F.explode(
                F.transform(
                    "members", lambda m: F.struct(m["node_id"], m["symbol"], aligned(m).alias("aligned"))
                )
            ).alias("n"),
        )
        .select("graph_id", "n.*")
    )
    return PoGraph(nodes, paths)


NODE_SCHEMA = "graph_id bigint, node_id bigint, symbol string, head bigint, aligned array<bigint>"


def grown_graph(sequences: DataFrame) -> PoGraph:
    """Graphs grown sequence by sequence, all graphs taking their next sequence together.

    Per round: look up the set a base points to, then the node of its symbol in that set;
    what is missing becomes a new node. ``head`` names a set by its first node.
    """
    spark = sequences.sparkSession
    placed = materialise_graph(bases(sequences), "bases")
    rounds = sorted(r[0] for r in placed.select("seq_rank").distinct().collect())
    nodes = spark.createDataFrame([], NODE_SCHEMA)
    paths = None
    for rank in rounds:
        here = placed.filter(F.col("seq_rank") == rank)
        pointed = nodes.select(
            "graph_id", F.col("node_id").alias("ref"), "head", F.col("aligned").alias("near")
        )
        owned = nodes.select("graph_id", "head", "symbol", F.col("node_id").alias("known"))
        found = here.join(pointed, ["graph_id", "ref"], "left").join(
            owned, ["graph_id", "head", "symbol"], "left"
        )
        sizes = nodes.groupBy("graph_id").agg(F.count("*").alias("size"))
        creation = Window.partitionBy("graph_id").orderBy("region", "pos")
        fresh = (
            found.filter("known is null")
            .join(sizes, "graph_id", "left")
            .withColumn(
                "fresh", F.coalesce("size", F.lit(0)) + F.row_number().over(creation) - 1
            )
            .select("graph_id", "pos", "fresh")
        )
        round_ = materialise_graph(
            found.join(fresh, ["graph_id", "pos"], "left").select(
                "graph_id", "seq_rank", "pos", "symbol", "weight", "ref", "head", "near", "fresh",
                F.coalesce("known", "fresh").alias("node_id"),
            ),
            "round",
        )
        added = round_.filter("fresh is not null")
        joined_sets = added.filter("head is not null").select(
            "graph_id", "head", F.col("fresh").alias("newcomer")
        )
        grown = nodes.join(joined_sets, ["graph_id", "head"], "left").select(
            "graph_id", "node_id", "symbol", "head",
            F.when(F.col("newcomer").isNull(), F.col("aligned"))
            .otherwise(F.concat("aligned", F.array("newcomer")))
            .alias("aligned"),
        )
        new_nodes = added.select(
            "graph_id", "node_id", "symbol", F.coalesce("head", "node_id").alias("head"),
            F.when(F.col("head").isNull(), F.expr("cast(array() as array<bigint>)"))
            .otherwise(F.concat("near", F.array("ref")))
            .alias("aligned"),
        )
        nodes = materialise_graph(grown.unionByName(new_nodes), "nodes")
        steps = round_.select("graph_id", "seq_rank", "pos", "node_id", "weight")
        paths = steps if paths is None else paths.unionByName(steps)
    return PoGraph(nodes.drop("head"), paths)


PAIRS = T.ArrayType(T.StructType([T.StructField("node", T.IntegerType()), T.StructField("pos", T.IntegerType())]))


def star_pairs(sequences: DataFrame, ops: str = "ops") -> DataFrame:
    """pairs from an edit script against the first sequence (pattern = first, text = seq).

    Nodes are characters, so the script must be one over characters (``unit="char"``).
    """

    @kernel(PAIRS)
    def paired(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield pd.Series([None if o is None else scripts.star_pairs(o) for o in column], dtype=object)

    return sequences.withColumn("pairs", paired(F.col(ops)))
