"""Ranks and heaviest-bundle consensus for graphs too large to pack into one row.

All graphs advance together, one level per round, with joins and pre-aggregated group-bys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seqloom.operators.numbering import number_within
from seqloom.operators.segments import levels
from seqloom.session import materialise_graph


def leader() -> Column:
    """The first node of an aligned set."""
    return F.least("node_id", F.coalesce(F.array_min("aligned"), F.col("node_id")))


def set_ranks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, rank, node_id: a topological order that keeps aligned nodes together.

    Aligned sets are peeled as one node each; ranks follow (level, set, node).
    """
    if "aligned" not in nodes.columns:
        nodes = nodes.withColumn("aligned", F.expr("cast(array() as array<bigint>)"))
    member = materialise_graph(nodes.select("graph_id", "node_id", leader().alias("set")), "sets")
    end = lambda name: member.select("graph_id", F.col("node_id").alias(name), F.col("set").alias(f"{name}_set"))
    between = (
        edges.select("graph_id", "src", "dst")
        .join(end("src"), ["graph_id", "src"])
        .join(end("dst"), ["graph_id", "dst"])
        .select("graph_id", F.col("src_set").alias("src"), F.col("dst_set").alias("dst"))
    )
    level = levels(member.select("graph_id", F.col("set").alias("node_id")).distinct(), between)
    placed = member.join(level.withColumnRenamed("node_id", "set"), ["graph_id", "set"])
    return number_within(placed, ["graph_id"], ["level", "set", "node_id"], "rank").select(
        "graph_id", "rank", "node_id"
    )


def heaviest_by_level(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scores before completion: graph_id, node_id, score; path: graph_id, pos, node_id).

    The same rules as for packed graphs, with nodes ranked by (level, node_id): heaviest
    in-edge, then the better predecessor, then the later edge; while the best node is no
    sink its rivals are set aside and all later nodes are scored again.
    """
    level = materialise_graph(levels(nodes.select("graph_id", "node_id"), edges), "level")
    depth = level.agg(F.max("level")).first()[0] or 0
    into = materialise_graph(
        edges.select("graph_id", "src", "dst", "weight", "ord").join(
            level.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"]
        ),
        "into",
    )
    blank = level.withColumn("score", F.lit(-1).cast("long")).withColumn("pred", F.lit(None).cast("long"))
    states = [blank.filter(F.col("level") == depth_) for depth_ in range(depth + 1)]
    low = level.select("graph_id").distinct().select(
        "graph_id", F.lit(-1).alias("low_level"), F.lit(-1).cast("long").alias("low_node")
    )
    first_scores, tips, again = None, None, False
    while True:
        for here in range(depth + 1):
            states[here] = materialise_graph(_score_level(states, here, into, low, again), "scores")
        scores = _all(states)
        first_scores = first_scores if again else scores.select("graph_id", "node_id", "score")
        best = scores.join(low, "graph_id").filter(_later()).groupBy("graph_id").agg(
            F.max(F.struct("score", -F.col("level"), -F.col("node_id"))).alias("b")
        )
        tip = materialise_graph(
            best.select("graph_id", (-F.col("b.col2")).alias("low_level"), (-F.col("b.col3")).alias("low_node")),
            "tip",
        )
        onward = into.select("graph_id", F.col("src").alias("low_node"), "dst")
        inner = tip.join(onward.select("graph_id", "low_node"), ["graph_id", "low_node"], "left_semi")
        ended = tip.join(inner.select("graph_id"), "graph_id", "left_anti")
        tips = ended if tips is None else tips.unionByName(ended)
        low = materialise_graph(inner.select(*tip.columns), "low")
        if low.isEmpty():
            break
        again = True
        rivals = (
            low.join(onward, ["graph_id", "low_node"])
            .join(into.select("graph_id", "dst", "src"), ["graph_id", "dst"])
            .filter("src <> low_node")
            .select("graph_id", F.col("src").alias("node_id"), F.lit(True).alias("aside"))
            .distinct()
        )
        states = [
            materialise_graph(
                s.join(rivals, ["graph_id", "node_id"], "left")
                .withColumn("score", F.when(F.col("aside"), F.lit(-1).cast("long")).otherwise(F.col("score")))
                .drop("aside"),
                "scores",
            )
            for s in states
        ]
    return first_scores, _trace(_all(states), tips)


def _all(states: list[DataFrame]) -> DataFrame:
    every = states[0]
    for state in states[1:]:
        every = every.unionByName(state)
    return every


def _later() -> Column:
    return F.struct("level", "node_id") > F.struct(F.col("low_level").alias("level"), F.col("low_node").alias("node_id"))


def _score_level(states: list[DataFrame], here: int, into: DataFrame, low: DataFrame, again: bool) -> DataFrame:
    """Score the nodes of one level that come after the low mark of their graph."""
    todo = states[here].join(low, "graph_id").filter(_later()).select("graph_id", "node_id", "level")
    fixed = states[here].join(todo.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_anti")
    if here == 0:
        best = todo.withColumn("b", F.lit(None).cast("struct<weight:bigint,score:bigint,ord:int,src:bigint>"))
    else:
        known = _all(states[:here]).select("graph_id", F.col("node_id").alias("src"), "score")
        if again:
            known = known.filter("score <> -1")
        chosen = (
            into.filter(F.col("level") == here)
            .drop("level")
            .join(known, ["graph_id", "src"])
            .groupBy("graph_id", F.col("dst").alias("node_id"))
            .agg(F.max(F.struct("weight", "score", "ord", "src")).alias("b"))
        )
        best = todo.join(chosen, ["graph_id", "node_id"], "left")
    scored = best.select(
        "graph_id", "node_id", "level",
        F.coalesce(F.col("b.weight") + F.col("b.score"), F.lit(-1)).cast("long").alias("score"),
        F.col("b.src").alias("pred"),
    )
    return fixed.select(*scored.columns).unionByName(scored)


def _trace(scores: DataFrame, tips: DataFrame) -> DataFrame:
    """Follow the chosen predecessors from every tip; one round per path step."""
    chosen = materialise_graph(scores.select("graph_id", "node_id", "pred"), "chosen")
    front = materialise_graph(tips.select("graph_id", F.col("low_node").alias("node_id")), "front")
    path, back = None, 0
    while not front.isEmpty():
        step = front.withColumn("back", F.lit(back))
        path = step if path is None else path.unionByName(step)
        front = materialise_graph(
            front.join(chosen, ["graph_id", "node_id"])
            .filter("pred is not null")
            .select("graph_id", F.col("pred").alias("node_id")),
            "front",
        )
        back += 1
    length = path.groupBy("graph_id").agg(F.max("back").alias("last"))
    return path.join(length, "graph_id").select(
        "graph_id", (F.col("last") - F.col("back")).alias("pos"), "node_id"
    )
