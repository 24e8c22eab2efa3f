"""Mixing sources to target weights by Poisson replication.

Every document is repeated a Poisson number of times whose mean is its source's target share
over its present share, drawn by inverting the distribution at a number hashed from the seed
and the document's id. The copies are then shuffled over the whole table. Built-in functions
only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from seqloom.llm.common import plain, shuffle_parts
from seqloom.session import materialise

SEED = 11
#: Larger rates are drawn in several parts, so the table of a source stays small.
LARGEST_RATE = 32


def uniform(key: Column) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 digest of a string."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def thresholds(rate: Column) -> Column:
    """Poisson(rate) distribution function at 0, 1, ... as far as a double can tell it from 1.

    For rates up to LARGEST_RATE. The count of a document is how many of these are at or
    below its number.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    none = F.exp(-rate)
    first = F.struct(F.array(none).alias("sums"), none.alias("term"), none.alias("total"))

    def step(state: Column, k: Column) -> Column:
        term = state["term"] * rate / k
        total = state["total"] + term
        sums = F.concat(state["sums"], F.array(total))
        return F.struct(sums.alias("sums"), term.alias("term"), total.alias("total"))

    return F.aggregate(F.sequence(F.lit(1), last), first, step, lambda state: state["sums"])


def source_rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, growth: float = 1.0) -> DataFrame:
    """(source, rate, draws, cdf): mean repetitions that bring each source to its weight.

    Shares are measured in characters of whole texts (null: none). Without ``weights`` all
    sources get the same; otherwise a source that is not named gets weight zero and vanishes.
    A null source is a source of its own, named None. The expected size of the result is
    ``growth`` times that of ``docs``. A source without any characters keeps rate ``growth``.

    A rate above LARGEST_RATE is drawn as a sum of ``draws`` independent Poisson numbers of
    equal smaller rates, whose distribution function is ``cdf``.
    """
    chars = F.sum(F.length(F.coalesce("text", F.lit(""))))
    sizes = docs.groupBy("source").agg(chars.alias("chars"))
    weight = F.lit(1.0)
    if weights is not None:
        named = [F.lit(x) for item in weights.items() if item[0] is not None for x in (item[0], float(item[1]))]
        found = F.create_map(*named)[F.col("source")] if named else F.lit(None)
        unnamed = F.when(F.col("source").isNull(), F.lit(float(weights.get(None, 0.0)))).otherwise(F.lit(0.0))
        weight = F.coalesce(found, unnamed)
    sizes = materialise(sizes.withColumn("weight", weight), "sources")
    full = F.col("chars") > 0
    totals = sizes.agg(F.sum("chars").alias("chars"), F.sum(F.when(full, F.col("weight"))).alias("weight")).first()
    share = F.col("weight") / F.lit(totals.weight or 1.0) * F.lit(totals.chars or 0) * F.lit(float(growth)) / F.col("chars")
    rated = sizes.select("source", F.when(full, share).otherwise(F.lit(float(growth))).alias("rate"))
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_RATE)).cast("int")
    rated = rated.withColumn("draws", draws)
    return rated.withColumn("cdf", thresholds(F.col("rate") / F.col("draws")))


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    growth: float = 1.0,
    seed: int = SEED,
) -> DataFrame:
    """All copies of the documents with their columns, __copy (from 0) and __shuffle, shuffled.

    A row with an id draws by the id, so rows that repeat an id are repeated alike; a row
    without one draws by its text. __shuffle is a hash of seed, row and copy; rows are dealt
    to partitions and sorted by it. Only doc_id, text and source are read; further columns
    are carried along, but for those whose name starts with two underscores. Empty tables give empty results.
    """
    docs = plain(docs)
    rates = source_rates(docs, weights, growth).select(
        F.col("source").alias("__source"), F.col("draws").alias("__draws"), F.col("cdf").alias("__cdf")
    )
    by_text = F.concat(F.lit("-"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    key = F.coalesce(F.col("doc_id").cast("string"), by_text)
    drawn = lambda j: F.size(
        F.filter("__cdf", lambda x: x <= uniform(F.concat(F.lit(f"{seed}:"), j.cast("string"), F.lit(":"), key)))
    )
    count = F.aggregate(F.sequence(F.lit(0), F.col("__draws") - 1), F.lit(0), lambda total, j: total + drawn(j))
    joined = docs.join(rates, F.col("source").eqNullSafe(F.col("__source")))
    copies = (
        joined.withColumn("__count", count)
        .filter("__count > 0")
        .withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__count") - 1)))
        .drop("__source", "__draws", "__cdf", "__count")
    )
    place = F.md5(F.concat(F.lit(f"{seed}/"), F.col("__copy").cast("string"), F.lit("/"), key).cast("binary"))
    dealt = copies.withColumn("__shuffle", place).repartition(shuffle_parts(docs), "__shuffle")
    return dealt.sortWithinPartitions("__shuffle")
