"""Nodes that lie on cycles, by strongly connected components, with joins alone.

Edges that no cycle can use are trimmed off round by round: those out of a node that nothing
enters, and those into a node that nothing leaves. In what is left every node takes the
largest name that reaches it; the nodes of one name from which its bearer can be reached are
the bearer's component, found backwards along edges of that name. They go, and the rest is
looked at again. All graphs advance together, and no graph has to fit anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqloom.session import materialise_graph

NODE = ["graph_id", "node_id"]


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges (graph_id, src, dst) that lie between nodes with a way in and a way out."""
    left, size = edges, edges.count()
    while size:
        entered = left.select("graph_id", F.col("dst").alias("src")).distinct()
        gone_from = left.select("graph_id", F.col("src").alias("dst")).distinct()
        kept = left.join(entered, ["graph_id", "src"], "left_semi").join(gone_from, ["graph_id", "dst"], "left_semi")
        kept = materialise_graph(kept.select("graph_id", "src", "dst"), "trimmed")
        before, size, left = size, kept.count(), kept
        if size == before:
            break
    return left


def largest_reaching(edges: DataFrame) -> DataFrame:
    """graph_id, node_id, name: the largest node that reaches each node of the edges, itself included."""
    ends = edges.select("graph_id", F.col("src").alias("node_id")).unionByName(edges.select("graph_id", F.col("dst").alias("node_id")))
    named = materialise_graph(ends.distinct().withColumn("name", F.col("node_id")).withColumn("fresh", F.lit(True)), "named")
    while True:
        # only names that grew in the last round are passed on
        told = (
            edges.join(named.filter("fresh").select("graph_id", F.col("node_id").alias("src"), "name"), ["graph_id", "src"])
            .groupBy("graph_id", F.col("dst").alias("node_id"))
            .agg(F.max("name").alias("told"))
        )
        grown = named.drop("fresh").join(told, NODE, "left").select(
            *NODE, F.greatest("name", "told").alias("name"), (F.coalesce("told", "name") > F.col("name")).alias("fresh")
        )
        named = materialise_graph(grown, "named")
        if named.filter("fresh").isEmpty():
            return named.drop("fresh")


def reaching_back(edges: DataFrame, named: DataFrame) -> DataFrame:
    """graph_id, node_id, name of the nodes from which the bearer of their name can be reached."""
    of = lambda end: named.select("graph_id", F.col("node_id").alias(end), F.col("name").alias(f"{end}_name"))
    inner = edges.join(of("src"), ["graph_id", "src"]).join(of("dst"), ["graph_id", "dst"]).filter("src_name = dst_name")
    inner = materialise_graph(inner.select("graph_id", "src", "dst", F.col("src_name").alias("name")), "inner")
    front = done = materialise_graph(named.filter("node_id = name"), "back")
    while True:
        found = inner.join(front.select("graph_id", F.col("node_id").alias("dst")), ["graph_id", "dst"])
        found = found.select("graph_id", F.col("src").alias("node_id"), "name").distinct()
        front = materialise_graph(found.join(done.select(*NODE), NODE, "left_anti"), "back")
        if front.isEmpty():
            return done
        done = materialise_graph(done.unionByName(front), "back")


def cycles(edges: DataFrame) -> DataFrame:
    """graph_id, node_id, component, size: every node on a cycle, with the smallest node and the size of its component.

    ``edges`` has graph_id, src and dst of one type that can be compared; repeated edges count
    once, an edge from a node to itself is a cycle. Edges with a null end are left out, a null
    graph_id too. Without cycles the result is empty.
    """
    links = edges.select("graph_id", "src", "dst").dropna().distinct()
    links = materialise_graph(links, "links")
    left, found = links.filter("src <> dst"), links.filter("src = dst").select("graph_id", F.col("src").alias("node_id"), F.col("src").alias("name"))
    while True:
        left = trimmed(left)
        if left.isEmpty():
            break
        inside = reaching_back(left, largest_reaching(left))
        found = materialise_graph(found.unionByName(inside), "found")
        out = lambda end: inside.select("graph_id", F.col("node_id").alias(end))
        left = left.join(out("src"), ["graph_id", "src"], "left_anti").join(out("dst"), ["graph_id", "dst"], "left_anti")
        left = materialise_graph(left.select("graph_id", "src", "dst"), "left")
    # a node that leads to itself may be alone or in a larger component, which then bears the larger name
    each = found.groupBy(*NODE).agg(F.max("name").alias("name"))
    sizes = each.groupBy("graph_id", "name").agg(F.min("node_id").alias("component"), F.count("*").alias("size"))
    loops = links.filter("src = dst").select("graph_id", F.col("src").alias("node_id"), F.lit(True).alias("loop"))
    return (
        each.join(sizes, ["graph_id", "name"])
        .join(loops, NODE, "left")
        .filter("size > 1 or loop")
        .select("graph_id", "node_id", "component", "size")
    )
