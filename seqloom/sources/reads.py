"""Symbol sequences ("reads") from the event stream.

Each user's events, in time order, spell a sequence of event initials. That sequence is
as long as the user is active, so it is cut into reads of READ_LENGTH symbols, and
READS_PER_BUNDLE consecutive reads form one bundle, the unit that becomes a graph. Every
event belongs to exactly one read; no bundle exceeds READ_LENGTH * READS_PER_BUNDLE symbols.
Pairs and triples of neighbouring reads go on over the border of a bundle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqloom.operators.numbering import number_within
from seqloom.session import materialise_graph
from seqloom.sources.tables import table

READ_LENGTH = 16
READS_PER_BUNDLE = 8

_written: dict[tuple[str, str], DataFrame] = {}


def event_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """graph_id (smallest event id in the bundle), user_id, bundle, seqs ARRAY<STRING>."""
    events = table(spark, folder, "events", "user_id", "ts", "event_id", "event_type").select(
        "user_id", "ts", "event_id", F.upper(F.substring("event_type", 1, 1)).alias("symbol")
    )
    numbered = number_within(events, ["user_id"], ["ts", "event_id"])
    span = READ_LENGTH * READS_PER_BUNDLE
    spelled = numbered.groupBy("user_id", F.expr(f"pos div {span}").alias("bundle")).agg(
        F.min("event_id").alias("graph_id"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("pos", "symbol"))), lambda e: e["symbol"]
            ),
            "",
        ).alias("spelling"),
    )
    cut = (
        f"transform(sequence(0, (length(spelling) - 1) div {READ_LENGTH}), "
        f"i -> substr(spelling, i * {READ_LENGTH} + 1, {READ_LENGTH}))"
    )
    return spelled.select("graph_id", "user_id", "bundle", F.expr(cut).alias("seqs"))


def written_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """The bundle table, built once per application and folder, then read back."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _written:
        _written[key] = materialise_graph(event_bundles(spark, folder), "bundles")
    return _written[key]


def reads(bundles: DataFrame) -> DataFrame:
    """graph_id, seq_rank, seq: one row per read; row-local."""
    return bundles.select("graph_id", F.posexplode("seqs").alias("seq_rank", "seq"))


def with_following(bundles: DataFrame, count: int) -> DataFrame:
    """graph_id, own (number of reads), seqs: the reads of a bundle and the user's next ``count``.

    ``count`` is at most READS_PER_BUNDLE, so the next bundle holds them. (user, bundle) is
    unique, so the join has no heavy key.
    """
    following = bundles.select(
        "user_id", (F.col("bundle") - 1).alias("bundle"), F.slice("seqs", 1, count).alias("more")
    )
    none = F.array().cast("array<string>")
    return bundles.join(following, ["user_id", "bundle"], "left").select(
        "graph_id", F.size("seqs").alias("own"), F.concat("seqs", F.coalesce("more", none)).alias("seqs")
    )


def read_pairs(bundles: DataFrame) -> DataFrame:
    """Each read with the user's next one: graph_id, seq_rank (of the first), a, b."""
    pairs = F.expr(
        "zip_with(slice(seqs, 1, greatest(size(seqs) - 1, 0)), slice(seqs, 2, size(seqs)),"
        " (a, b) -> struct(a, b))"
    )
    return with_following(bundles, 1).select("graph_id", F.posexplode(pairs).alias("seq_rank", "pair")).select(
        "graph_id", "seq_rank", "pair.a", "pair.b"
    )
