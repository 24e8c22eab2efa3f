"""Registered queries: counters, arithmetic and symbol classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import maths, stats, symbols
from seqloom.plans.oracle import hundredths_sql, scaled_count_sql, scaled_sql, scaled_whole_sql
from seqloom.plans.registry import query
from seqloom.session import spread
from seqloom.sources.tables import table

FLAGS = "l_returnflag, l_linestatus"


def quantities(spark, folder):
    return table(spark, folder, "lineitem", "l_returnflag", "l_linestatus", "l_suppkey", "l_quantity").withColumn(
        "amount", F.col("l_quantity").cast("long")
    )


def rounded(df, *columns):
    return df.select(*[F.round(c, 6).alias(c) if c in columns else c for c in df.columns])


MOMENTS = ("mean", "variance", "stddev")
COUNTER_SQL = """sum(amount)::BIGINT AS total, count(amount) AS samples, min(amount) AS min, max(amount) AS max,
round(avg(amount), 6) AS mean, round(coalesce(var_samp(amount), 0), 6) AS variance,
round(coalesce(stddev_samp(amount), 0), 6) AS stddev"""
AMOUNTS = "(SELECT *, l_quantity::BIGINT AS amount FROM lineitem)"


@query(f"SELECT {COUNTER_SQL} FROM {AMOUNTS}")
def counter_stats(spark, folder):
    return rounded(stats.counter(quantities(spark, folder), "amount"), *MOMENTS)


@query(f"SELECT {FLAGS}, {COUNTER_SQL} FROM {AMOUNTS} GROUP BY {FLAGS}")
def counter_by_group(spark, folder):
    counted = stats.counter(quantities(spark, folder), "amount", "l_returnflag", "l_linestatus")
    return rounded(counted, *MOMENTS)


@query(f"SELECT l_returnflag, {COUNTER_SQL} FROM {AMOUNTS} GROUP BY 1")
def counter_combined(spark, folder):
    partial = stats.counter(quantities(spark, folder), "amount", "l_returnflag", "l_suppkey")
    return rounded(stats.combine(partial, "l_returnflag"), *MOMENTS)


def totals_only(spark, folder, how):
    partial = stats.counter(quantities(spark, folder), "amount", "l_returnflag", "l_suppkey")
    kept = stats.combine(partial, "l_returnflag", how=how)
    return kept.select("l_returnflag", "total", "min", "max")


PARTIAL = f"""WITH parts AS (SELECT l_returnflag, l_suppkey, sum(amount)::BIGINT AS total, min(amount) AS lo,
max(amount) AS hi FROM {AMOUNTS} GROUP BY 1, 2)"""


@query(f"{PARTIAL} SELECT l_returnflag, max(total) AS total, min(lo) AS min, max(hi) AS max FROM parts GROUP BY 1")
def counter_combined_max(spark, folder):
    return totals_only(spark, folder, "max")


@query(f"""{PARTIAL} SELECT l_returnflag, min(nullif(total, 0)) AS total, min(lo) AS min, max(hi) AS max
FROM parts GROUP BY 1""")
def counter_combined_min(spark, folder):
    return totals_only(spark, folder, "min")


@query(f"""{PARTIAL} SELECT l_returnflag, floor(avg(total))::BIGINT AS total, min(lo) AS min, max(hi) AS max
FROM parts GROUP BY 1""")
def counter_combined_mean(spark, folder):
    return totals_only(spark, folder, "mean")


def sampler_sql() -> str:
    parts = ["' (samples='", scaled_count_sql("samples")]
    for name, column in (("{mean", "mean"), (",min", "min"), (",Max", "max"),
                         (",Var", "floor(variance)::BIGINT"), (",StdDev", "floor(stddev)::BIGINT")):
        parts += [f"'{name}'", scaled_sql(column) if column == "mean" else scaled_whole_sql(column)]
    return " || ".join(f"({p})" for p in parts) + " || ')}'"


REPORT = f"""WITH counters AS (SELECT {FLAGS}, {COUNTER_SQL} FROM {AMOUNTS} GROUP BY {FLAGS}),
whole AS (SELECT sum(amount)::BIGINT AS whole FROM {AMOUNTS})"""


@query(f"""{REPORT} SELECT {FLAGS}, ({scaled_whole_sql("total", 7, " ")}) || CASE WHEN total >= 1000 THEN 'u' ELSE 'u ' END
|| '           ' || {sampler_sql()} AS line FROM counters""")
def counter_report(spark, folder):
    counted = stats.counter(quantities(spark, folder), "amount", "l_returnflag", "l_linestatus")
    return counted.select("l_returnflag", "l_linestatus", stats.counter_text("u").alias("line"))


@query(f"""{REPORT} SELECT {FLAGS}, printf('(%6.2f %%)', total * 100.0::DOUBLE / whole) AS share FROM counters, whole""")
def counter_share(spark, folder):
    counted = stats.counter(quantities(spark, folder), "amount", "l_returnflag", "l_linestatus")
    whole = counted.agg(F.sum("total")).scalar()
    return counted.select(
        "l_returnflag", "l_linestatus", stats.share_text(F.col("total"), whole).alias("share")
    )


@query(f"""{REPORT} SELECT {FLAGS}, printf('%7.2f %%', mean) || chr(9) || chr(9) || ' (samples=' ||
({scaled_count_sql("samples")}) || printf(',min%.2f%%,Max%.2f%%,Var%.2f,StdDev%.2f)', min::DOUBLE, max::DOUBLE, variance, stddev)
AS line FROM counters""")
def percentage_report(spark, folder):
    counted = stats.counter(quantities(spark, folder), "amount", "l_returnflag", "l_linestatus")
    return counted.select("l_returnflag", "l_linestatus", stats.percentage_text().alias("line"))


@query("""SELECT l_suppkey, CASE WHEN count(*) = 0 THEN 0.0 ELSE round(100.0::DOUBLE *
sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / count(*), 6) END AS returned FROM lineitem GROUP BY 1""")
def percentages(spark, folder):
    rows = table(spark, folder, "lineitem", "l_suppkey", "l_returnflag")
    counted = rows.groupBy("l_suppkey").agg(
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("r"), F.count("*").alias("n")
    )
    return counted.select("l_suppkey", F.round(maths.percentage(F.col("r"), F.col("n")), 6).alias("returned"))


@query("""SELECT o_orderkey, least(o_orderkey + o_custkey, 1000) AS added,
greatest(o_orderkey - o_custkey, 0) AS subtracted,
CASE WHEN o_custkey = 0 THEN 0 ELSE o_orderkey // o_custkey END AS down,
CASE WHEN o_custkey = 0 THEN 0 ELSE (o_orderkey + o_custkey - 1) // o_custkey END AS up,
o_orderkey & 1 AS bit, o_orderkey & (-2) AS rest, o_orderkey >> 10 AS kib FROM orders""")
def bounded_math(spark, folder):
    a, b = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, folder, "orders", "o_orderkey", "o_custkey").select(
        "o_orderkey",
        maths.bounded_add(a, b, F.lit(1000)).alias("added"),
        maths.bounded_subtract(a, b, F.lit(0)).alias("subtracted"),
        maths.divide_down(a, b).alias("down"),
        maths.divide_up(a, b).alias("up"),
        maths.last_bit(a).alias("bit"),
        maths.without_last_bit(a).alias("rest"),
        maths.kibibytes(a).alias("kib"),
    )


@query(f"""SELECT o_orderkey, {scaled_count_sql("cents")} AS amount,
CASE WHEN ns >= 60000000000 THEN {hundredths_sql("ns", 60000000000)} || ' m'
WHEN ns >= 1000000000 THEN {hundredths_sql("ns", 1000000000)} || ' s'
WHEN ns >= 1000000 THEN {hundredths_sql("ns", 1000000)} || ' ms'
WHEN ns >= 1000 THEN {hundredths_sql("ns", 1000)} || ' us' ELSE ns || ' ns' END AS duration
FROM (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS cents, o_orderkey * o_orderkey * 7 AS ns FROM orders)""")
def humanized_units(spark, folder):
    key = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return table(spark, folder, "orders", "o_orderkey", "o_totalprice").select(
        "o_orderkey", stats.scaled_count(cents).alias("amount"),
        stats.duration_text(key * key * 7).alias("duration"),
    )


@query("""SELECT symbol, CASE symbol WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 4 END::BIGINT
AS base, count(*) AS rows FROM (SELECT unnest(regexp_extract_all(upper(event_type), '(?s).')) AS symbol FROM events
UNION ALL SELECT l_returnflag FROM lineitem) GROUP BY 1, 2""")
def base_index(spark, folder):
    letters = F.regexp_extract_all(F.upper("event_type"), F.lit("(?s)."), F.lit(0))
    events = table(spark, folder, "events", "event_type").select(F.explode(letters).alias("symbol"))
    flags = table(spark, folder, "lineitem", "l_returnflag").select(F.col("l_returnflag").alias("symbol"))
    return (
        events.unionByName(flags).groupBy("symbol").agg(F.count("*").alias("rows"))
        .select("symbol", symbols.base_index(F.col("symbol")).alias("base"), "rows")
    )


# The same classes as regular expressions of what is not in them.
OUTSIDE = {
    "digit": "[^0-9]",
    "letter": "[^A-Za-z]",
    "alphanumeric": "[^0-9A-Za-z]",
    "hex_digit": "[^0-9A-Fa-f]",
    "eol": "[^\\n]",
    "any_eol": "[^\\n\\r]",
    "end_of_record": "[^\\n\\x00]",
    "end_of_field": "[^\\n\\x00 \\t]",
}
CLASS_SQL = ", ".join(
    f"len(regexp_replace(text, '{pattern}', '', 'g')) AS {name}" for name, pattern in OUTSIDE.items()
)


@query(f"SELECT doc_id, {CLASS_SQL} FROM documents")
def char_classes(spark, folder):
    text = F.col("text")
    return spread(table(spark, folder, "documents", "doc_id", "text")).select(
        "doc_id", *[symbols.count_class(text, name).alias(name) for name in symbols.CLASSES]
    )


@query("""SELECT page_id, place, regexp_full_match(c, '[0-9]') AS is_digit, regexp_full_match(c, '[A-Za-z]') AS is_letter,
(instr('0123456789abcdef', c) - 1)::BIGINT AS hex, CASE WHEN regexp_full_match(c, '[0-9]') THEN ascii(c) - 48 END::BIGINT AS digit
FROM (SELECT page_id, unnest(range(32))::INT AS place, unnest(regexp_extract_all(md5(url), '.')) AS c FROM pages)""")
def digit_decode(spark, folder):
    c = F.col("c")
    digits = F.regexp_extract_all(F.md5("url"), F.lit("."), F.lit(0))
    symbols_ = table(spark, folder, "pages", "page_id", "url").select("page_id", F.posexplode(digits).alias("place", "c"))
    return symbols_.select(
        "page_id",
        "place",
        symbols.is_class(c, "digit").alias("is_digit"),
        symbols.is_class(c, "letter").alias("is_letter"),
        symbols.hex_digit(c).alias("hex"),
        F.when(symbols.is_class(c, "digit"), symbols.digit(c)).alias("digit"),
    )
