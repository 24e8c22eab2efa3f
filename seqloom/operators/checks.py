"""Schemas of the graph tables and rows that break their rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMAS = {
    "sequences": "graph_id bigint, seq_rank int, seq string, pairs array<struct<node: int, pos: int>>",
    "segments": "graph_id bigint, segment_id bigint, sequence string",
    "nodes": "graph_id bigint, node_id bigint, symbol string, aligned array<bigint>",
    "edges": "graph_id bigint, src bigint, dst bigint, weight bigint, ord int",
    "paths": "graph_id bigint, seq_rank int, pos int, node_id bigint, weight bigint",
    "ranks": "graph_id bigint, rank int, node_id bigint",
    "queries": "graph_id bigint, query_id bigint, pattern string",
}


def empty(spark: SparkSession, table: str) -> DataFrame:
    """An empty graph table to start from."""
    return spark.createDataFrame([], SCHEMAS[table])


def alignment_problems(sequences: DataFrame) -> DataFrame:
    """graph_id, seq_rank, problem for alignments that cannot be added to a graph.

    Aligned positions must exist, be consecutive and cover something, and weights must be
    as many as symbols. Row-local.
    """
    used = F.filter("pairs", lambda p: p["pos"].isNotNull())["pos"]
    aligned = F.coalesce(F.size("pairs"), F.lit(0)) > 0
    first = F.get(used, F.lit(0))
    consecutive = F.sequence(first, first + F.size(used) - 1)
    problem = (
        F.when(aligned & (F.size(used) == 0), "alignment names no position")
        .when(aligned & ((F.array_max(used) >= F.length("seq")) | (F.array_min(used) < 0)), "position outside the sequence")
        .when(aligned & (used != consecutive), "positions are not consecutive")
    )
    if "weights" in sequences.columns:
        unequal = F.col("weights").isNotNull() & (F.size("weights") != F.length("seq"))
        problem = F.when(unequal, "not one weight for each symbol").otherwise(problem)
    return sequences.select("graph_id", "seq_rank", problem.alias("problem")).filter("problem is not null")


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ids = lambda end: nodes.select("graph_id", F.col("node_id").alias(end))
    lost = [edges.join(ids(end), ["graph_id", end], "left_anti") for end in ("src", "dst")]
    return lost[0].unionByName(lost[1]).distinct()
