"""Joins where one key may hold a large share of the left rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HOT_ROWS = 250_000  # left rows of one key that go to one task at most, on average


def spread_sides(
    left: DataFrame, right: DataFrame, key: str, scatter: str, hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``salt`` column: a hot left key is split into as many salts as it has
    times ``hot_rows`` rows, and its right rows are repeated once per salt. Join on
    [key, "salt"].

    Keys are counted with map-side aggregation. Fewer than rows/hot_rows keys can be hot,
    so the list of hot keys is small by construction and is broadcast. ``scatter`` is a
    left column (a row id) that decides which copy a row meets.
    """
    ways = F.ceil(F.col("count") / hot_rows).cast("int")
    hot = F.broadcast(
        left.groupBy(key).count().filter(F.col("count") > hot_rows).select(key, ways.alias("__ways"))
    )
    salt = F.coalesce(F.pmod(F.xxhash64(scatter), F.col("__ways")), F.lit(0)).cast("int")
    copies = F.sequence(F.lit(0), F.coalesce("__ways", F.lit(1)) - 1)
    return (
        left.join(hot, key, "left").withColumn("salt", salt).drop("__ways"),
        right.join(hot, key, "left").withColumn("salt", F.explode(copies)).drop("__ways"),
    )


def spread_join(
    left: DataFrame, right: DataFrame, key: str, scatter: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Inner join on ``key`` that keeps hot left keys out of single tasks."""
    one, other = spread_sides(left, right, key, scatter, hot_rows)
    return one.join(other, [key, "salt"]).drop("salt")
