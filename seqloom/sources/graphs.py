"""Graph workloads derived from the bundle table; all row-local until nodes are merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from seqloom.operators.pairwise import align
from seqloom.operators.pograph import PoGraph, po_graph, star_graph, star_pairs
from seqloom.session import dealt, materialise_graph
from seqloom.sources.reads import READS_PER_BUNDLE, reads, with_following, written_bundles

_written: dict[tuple[str, str, str], PoGraph] = {}

#: Bundles that one task makes bases of, on average.
BUNDLES_A_TASK = 4_000


def positional_sequences(bundles: DataFrame) -> DataFrame:
    """Reads of a bundle, each aligned position by position to the first one."""
    same = F.transform(
        F.sequence(F.lit(0), F.length("seq") - 1), lambda i: F.struct(i.alias("node"), i.alias("pos"))
    )
    return reads(bundles).withColumn("pairs", F.when(F.col("seq_rank") > 0, same))


def star_sequences(bundles: DataFrame) -> DataFrame:
    """Reads of a bundle, each aligned to the first one by edit distance."""
    first = bundles.select(
        "graph_id", F.col("seqs")[0].alias("first"), F.posexplode("seqs").alias("seq_rank", "seq")
    )
    scripted = first.select("graph_id", "seq_rank", "seq", align(F.col("first"), F.col("seq"), unit="char").alias("a"))
    ops = F.when(F.col("seq_rank") > 0, F.col("a.ops"))
    return star_pairs(scripted.select("graph_id", "seq_rank", "seq", ops.alias("ops"))).drop("ops")


def positional_graph(spark: SparkSession, folder: str) -> PoGraph:
    return star_graph(positional_sequences(dealt(written_bundles(spark, folder), BUNDLES_A_TASK, "graph_id")))


def star_aligned_graph(spark: SparkSession, folder: str) -> PoGraph:
    aligned = materialise_graph(star_sequences(written_bundles(spark, folder)), "aligned")
    return po_graph(dealt(aligned, BUNDLES_A_TASK * READS_PER_BUNDLE, "graph_id"))


def written_graph(spark: SparkSession, folder: str, kind: str = "positional") -> PoGraph:
    """The graph tables, built once per application and folder, then read back."""
    key = (spark.sparkContext.applicationId, folder, kind)
    if key not in _written:
        build = positional_graph if kind == "positional" else star_aligned_graph
        _written[key] = build(spark, folder).written()
    return _written[key]


def ladders(bundles: DataFrame) -> DataFrame:
    """graph_id, a, b, pattern: every three consecutive reads of a user."""
    triples = F.transform(
        F.sequence(F.lit(0), F.size("seqs") - 3),
        lambda i: F.struct(
            i.alias("at"),
            F.get("seqs", i).alias("a"),
            F.get("seqs", i + 1).alias("b"),
            F.get("seqs", i + 2).alias("pattern"),
        ),
    )
    return (
        with_following(bundles, 2)
        .filter(F.size("seqs") >= 3)
        .select("graph_id", F.explode(triples).alias("t"))
        .select(
            (F.col("graph_id") * READS_PER_BUNDLE + F.col("t.at")).alias("graph_id"),
            "t.a", "t.b", "t.pattern",
        )
    )


def text_sequences(rows: DataFrame, graph: str, order: str) -> DataFrame:
    """Whole texts (column text) of each ``graph``, aligned position by position to the first.

    Nothing is cut: a graph has as many nodes as its texts need. A text behind the end of
    the first one is aligned as far as that goes, the rest stands alone. ``pairs`` has a pair
    per place, ``runs`` the same as one stretch; whoever needs one of them drops the other.
    """
    own = Window.partitionBy(graph)
    first = rows.filter(F.col(graph).isNotNull()).withColumns(
        {"size": F.min_by(F.length("text"), F.col(order)).over(own), "first": F.min(order).over(own)}
    )
    shared = F.least("size", F.length("text"))
    same = F.when(
        shared > 0,
        F.transform(F.sequence(F.lit(0), shared - 1), lambda i: F.struct(i.cast("int").alias("node"), i.cast("int").alias("pos"))),
    )
    run = F.struct(F.lit(0).alias("node"), F.lit(0).alias("pos"), shared.alias("length"))
    stretch = F.when(shared > 0, F.array(run))
    return first.select(
        F.col(graph).alias("graph_id"),
        (F.col(order) - F.col("first")).cast("int").alias("seq_rank"),
        F.col("text").alias("seq"),
        F.when(F.col(order) > F.col("first"), same).alias("pairs"),
        F.when(F.col(order) > F.col("first"), stretch).alias("runs"),
    )


def ladder_graph(rungs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, edges, queries): reads a and b in thirds, free to cross between thirds.

    Segments 1-3 are the thirds of a, 4-6 those of b; the own continuation weighs 2, a
    crossing 1. The query is the read that follows.
    """
    def third(name: str, part: int):
        size = F.length(name)
        low = F.floor(size * part / 3).cast("int")
        return F.substr(F.col(name), low + 1, F.floor(size * (part + 1) / 3).cast("int") - low)

    cells = [
        F.struct(F.lit(3 * r + p + 1).cast("long").alias("segment_id"), third(name, p).alias("sequence"))
        for r, name in enumerate("ab") for p in range(3)
    ]
    segments = rungs.select("graph_id", F.explode(F.array(*cells)).alias("s")).select("graph_id", "s.*")
    links = [
        (3 * r + p + 1, 3 * q + p + 2, 2 if r == q else 1)
        for p in range(2) for r in range(2) for q in range(2)
    ]
    steps = F.array(*[
        F.struct(
            F.lit(u).cast("long").alias("src"), F.lit(v).cast("long").alias("dst"),
            F.lit(w).cast("long").alias("weight"), F.lit(at).alias("ord"),
        )
        for at, (u, v, w) in enumerate(links)
    ])
    edges = rungs.select("graph_id", F.explode(steps).alias("e")).select("graph_id", "e.*")
    queries = rungs.select("graph_id", F.col("graph_id").alias("query_id"), "pattern")
    return segments, edges, queries
