"""Connected components of an undirected graph of long ids, with Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqloom.session import materialise


def _state(edges: DataFrame) -> tuple:
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), digest).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node reachable.

    Alternates large-star and small-star steps: every node is hung on the smallest of its
    neighbours, which shortens all paths at once, so the number of rounds grows with the
    logarithm of the longest path. Minima are combined before the shuffle, and joins on a
    node with many links are left to Spark's skew handling. A round is one written table,
    and only a count and a checksum come to the driver.
    """
    edges = materialise(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    state = _state(edges)
    while state[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = (
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        )
        edges = materialise(small.select("e.*").filter("u <> v").distinct(), "links")
        last, state = state, _state(edges)
        if state == last:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
