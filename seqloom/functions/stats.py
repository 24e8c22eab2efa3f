"""Running counters as aggregates, their correct combination, and their printed forms."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from seqloom.functions.maths import whole_quotient

# Metric prefixes of printed counters.
PREFIXES = ((1_000_000_000, "G"), (1_000_000, "M"), (1_000, "K"))


def counter(df: DataFrame, amount: str, *keys: str) -> DataFrame:
    """total, samples, min, max, mean, sample variance (0 for one sample) and stddev."""
    value = F.col(amount)
    aggregates = [
        F.sum(value).alias("total"),
        F.count(value).alias("samples"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("mean"),
        F.coalesce(F.var_samp(value), F.lit(0.0)).alias("variance"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stddev"),
    ]
    return df.groupBy(*keys).agg(*aggregates)


def combine(counters: DataFrame, *keys: str, how: str = "sum") -> DataFrame:
    """Combine counter rows.

    sum  : as if all samples had gone into one counter; the spread is summed around the
           pooled mean, so large means cost no digits
    max  : total and samples of the counter with the largest total
    min  : the same with the smallest non-zero total
    mean : average total and samples
    min, max bound all counters in every case.
    """
    n, mean = F.col("samples"), F.col("mean")
    pooled = counters.groupBy(*keys).agg((F.sum(n * mean) / F.sum(n)).alias("__pooled"))
    if keys:
        pooled = pooled.select(*[F.col(k).alias(f"__{k}") for k in keys], "__pooled")
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
        counters = counters.join(pooled, same)
    else:
        counters = counters.withColumn("__pooled", F.lit(pooled.first()[0]))
    away = mean - F.col("__pooled")
    spread = F.sum(F.col("variance") * (n - 1)) + F.sum(n * away * away)
    variance = F.coalesce(F.when(F.sum(n) > 1, spread / (F.sum(n) - 1)), F.lit(0.0))
    filled = F.when(F.col("total") != 0, F.col("total"))
    totals = {
        "sum": (F.sum("total"), F.sum("samples")),
        "max": (F.max("total"), F.max_by("samples", "total")),
        "min": (F.coalesce(F.min(filled), F.lit(0)), F.coalesce(F.min_by("samples", filled), F.lit(0))),
        "mean": (F.floor(F.avg("total")), F.floor(F.avg("samples"))),
    }
    total, samples = totals[how]
    return counters.groupBy(*keys).agg(
        total.alias("total"),
        samples.alias("samples"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        (F.sum(n * mean) / F.sum(n)).alias("mean"),
        variance.alias("variance"),
        F.sqrt(variance).alias("stddev"),
    )


def hundredths(value: Column, factor: int, width: int = 0) -> Column:
    """value / factor with two decimals, ties upwards, in whole-number arithmetic."""
    # value = whole * factor + rest, so that nothing passes the largest long
    whole, rest = whole_quotient(value, F.lit(factor)), value.cast("long") % factor
    part = whole_quotient(rest * 100 + factor // 2, F.lit(factor))
    whole, part = whole + (part >= 100).cast("long"), part % 100
    text = F.concat(
        whole.cast("string"), F.lit("."), F.lpad(part.cast("string"), 2, "0")
    )
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit(" ")) if width else text


def scaled_whole(value: Column, width: int = 0, after: str = "") -> Column:
    """A whole number with G, M or K, e.g. 12.35K; ``after`` precedes the prefix."""
    text = F.concat(hundredths(value, 1, width), F.lit(after))
    for factor, prefix in reversed(PREFIXES):
        part = F.concat(hundredths(value, factor, width), F.lit(after + prefix))
        text = F.when(value >= factor, part).otherwise(text)
    return text


def scaled(value: Column) -> Column:
    """A fractional number with G, M or K."""
    text = F.format_string("%.2f", value)
    for factor, prefix in reversed(PREFIXES):
        text = F.when(value >= factor, F.format_string("%.2f" + prefix, value / factor)).otherwise(text)
    return text


def scaled_count(value: Column) -> Column:
    """Whole number with its prefix, rounded down."""
    text = value.cast("long").cast("string")
    for factor, prefix in reversed(PREFIXES):
        whole = whole_quotient(value, F.lit(factor)).cast("string")
        text = F.when(value >= factor, F.concat(whole, F.lit(prefix))).otherwise(text)
    return text


def share_text(total: Column, reference: Column) -> Column:
    """Percentage of a reference total, as printed behind a counter."""
    return (
        F.when(total == 0, "(  0.00 %)")
        .when(reference == 0, "(  n/a  %)")
        .otherwise(F.format_string("(%6.2f %%)", total * 100.0 / reference))
    )


# Labels of a printed counter and of its statistics.
SAMPLES, NO_SAMPLES, END = " (samples=", " (samples=0,--n/a--)}", ")}"
STATISTICS = (("{mean", "mean"), (",min", "min"), (",Max", "max"), (",Var", "variance"), (",StdDev", "stddev"))
SPREAD = ",min%.2f%%,Max%.2f%%,Var%.2f,StdDev%.2f)"


def counter_text(units: str, reference: Column | None = None) -> Column:
    """One printed line for a row of ``counter``."""
    total = F.col("total")
    amount = scaled_whole(total, 7, " ")
    padded = F.when(total >= PREFIXES[-1][0], F.concat(amount, F.lit(units))).otherwise(
        F.concat(amount, F.lit(units + " "))
    )
    share = F.lit(" " * 11) if reference is None else F.concat(F.lit(" "), share_text(total, reference))
    return F.concat(padded, share, sampler_text())


def sampler_text() -> Column:
    """The statistics part of a printed counter; variance and stddev are whole numbers."""
    parts = [F.lit(SAMPLES), scaled_count(F.col("samples"))]
    for name, column in STATISTICS:
        value = F.col(column)
        parts += [F.lit(name), scaled(value) if column == "mean" else scaled_whole(F.floor(value))]
    return F.when(F.col("samples") == 0, F.lit(NO_SAMPLES)).otherwise(F.concat(*parts, F.lit(END)))


def percentage_text(units: str = "") -> Column:
    """A counter of percentages: mean, samples, range and spread."""
    head = F.concat(
        F.format_string(f"%7.2f %%{units}\t\t", F.col("mean")),
        F.lit(SAMPLES), scaled_count(F.col("samples")),
    )
    spread = F.format_string(
        SPREAD,
        *[F.col(c).cast("double") for c in ("min", "max", "variance", "stddev")],
    )
    return F.concat(head, spread)


# Units of printed durations in nanoseconds.
DURATIONS = ((60_000_000_000, "m"), (1_000_000_000, "s"), (1_000_000, "ms"), (1_000, "us"))


def duration_text(nanoseconds: Column) -> Column:
    text = F.concat(nanoseconds.cast("long").cast("string"), F.lit(" ns"))
    for factor, unit in reversed(DURATIONS):
        part = F.concat(hundredths(nanoseconds, factor), F.lit(f" {unit}"))
        text = F.when(nanoseconds >= factor, part).otherwise(text)
    return text
