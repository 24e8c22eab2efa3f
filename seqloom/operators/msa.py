"""Multiple sequence alignment rows from a partial-order graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from seqloom.kernels.whole import Whole
from seqloom.operators import whole
from seqloom.operators.pograph import ordinal
from seqloom.session import materialise_graph


def columns(nodes: DataFrame, ranks: DataFrame) -> DataFrame:
    """graph_id, node_id, column: aligned nodes share one, columns follow the ranks.

    ``ranks`` must keep aligned nodes next to each other (order 'depth').
    """
    graphs = whole.shared(nodes=nodes, ranks=ranks)
    if graphs is not None:
        return whole.placed(graphs.walked(["column"], lambda g: [g.columns(g.made["order"])]))
    leader = F.least("node_id", F.coalesce(F.array_min("aligned"), F.col("node_id")))
    ranked = materialise_graph(
        nodes.select("graph_id", "node_id", leader.alias("leader")).join(ranks, ["graph_id", "node_id"]),
        "ranked",
    )
    sets = materialise_graph(
        ranked.groupBy("graph_id", "leader").agg(F.min("rank").alias("first_rank")), "sets"
    )
    numbered = ordinal(sets, "graph_id", ["first_rank"], "column")
    return ranked.select("graph_id", "node_id", "leader").join(
        numbered.select("graph_id", "leader", "column"), ["graph_id", "leader"]
    ).select("graph_id", "node_id", "column")


def rows(paths: DataFrame, nodes: DataFrame, placed: DataFrame) -> DataFrame:
    """graph_id, seq_rank, row: one gapped row per sequence.

    ``paths`` needs graph_id, seq_rank, node_id; a consensus path with seq_rank null gives
    the consensus row.
    """
    graphs = whole.shared(paths=paths, nodes=nodes, placed=placed)
    if graphs is not None:

        def spelled_out(g: Whole) -> list:
            ranks, texts = g.rows(g.made["column"])
            return [whole.ranked(ranks), texts]

        return graphs.rows([T.StructField("seq_rank", T.IntegerType()), T.StructField("row", T.StringType())], spelled_out)
    width = placed.groupBy("graph_id").agg((F.max("column") + 1).cast("int").alias("width"))
    cells = F.array_sort(F.collect_list(F.struct("column", "symbol")))
    gathered = (
        paths.select("graph_id", "seq_rank", "node_id")
        .join(nodes.select("graph_id", "node_id", "symbol"), ["graph_id", "node_id"])
        .join(placed, ["graph_id", "node_id"])
        .groupBy("graph_id", "seq_rank")
        .agg(cells.alias("cells"))
    )
    # gaps before each symbol come from the distance to the previous column
    before = F.concat(F.array(F.lit(-1).cast("long")), F.slice("cells.column", 1, F.size("cells") - 1))
    spelled = F.zip_with(
        "cells",
        before,
        lambda cell, last: F.concat(
            F.repeat(F.lit("-"), (cell["column"] - last - 1).cast("int")), cell["symbol"]
        ),
    )
    return gathered.join(width, "graph_id").select(
        "graph_id", "seq_rank",
        F.rpad(F.array_join(spelled, ""), F.col("width"), F.lit("-")).alias("row"),
    )
