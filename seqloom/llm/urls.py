"""Allow and block rules over URLs by hashed host-suffix and path-prefix expressions.

Each URL is written out as all combinations of a suffix of its host (whole labels) and a
prefix of its path; each rule is one such expression. Both sides are joined on the first
bytes of a SHA-256 digest, matches are confirmed by the whole digest, and the most specific
rule decides. Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seqloom.session import materialise

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Hex digits of the digest in the join key; the whole digest confirms.
KEY_DIGITS = 8
#: Up to so many rules are sent to every task.
BROADCAST_RULES = 10_000


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Rules (verdict, host, path) as a DataFrame, without leaving the JVM."""
    empty = F.array().cast("array<struct<verdict:string,host:string,path:string>>")
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*rows) if rows else empty))


def host_of(url: Column) -> Column:
    """Between the first :// and the next of / ? # or the end, A-Z in lower case; else empty."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(raw, upper, upper.lower())


def path_of(url: Column) -> Column:
    """From the end of the host up to ? # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column) -> Column:
    """The host itself and what follows each of its dots."""
    labels = F.split(host, r"\.", -1)
    size = F.size(labels)
    return F.transform(F.sequence(F.lit(1), size), lambda i: F.array_join(F.slice(labels, i, size), "."))


def path_prefixes(path: Column, lengths: Sequence[int] = ()) -> Column:
    """Prefixes that end in a slash, the whole path, and prefixes of the given lengths."""
    parts = F.split(path, "/", -1)
    folders = F.when(
        F.size(parts) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    others = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    return F.array_distinct(F.concat(folders, F.array(F.lit(""), path, *others)))


def judge(
    pages: DataFrame,
    rules: DataFrame | Sequence[tuple[str, str, str]] = RULES,
    default: str = "allow",
) -> DataFrame:
    """One row per page row: page_id, host, path, rule (host and path, or null), verdict.

    A rule fits its host and all subdomains if the path starts with the rule's path. Of
    several, the longest (host and path together) decides, then the longer host, then block.
    A URL without a rule, a null URL and one without :// get the default verdict. Rules may
    repeat. ``rules`` given as a table may have any size; rows with a null are ignored.
    Further columns of ``pages`` are ignored.
    """
    spark = pages.sparkSession
    small = not isinstance(rules, DataFrame) and len(rules) <= BROADCAST_RULES
    table = rules if isinstance(rules, DataFrame) else rule_table(spark, rules)
    table = table.select("verdict", F.col("host").alias("r_host"), F.col("path").alias("r_path")).dropna()
    digest = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    expression = lambda host, path: F.concat(host, F.lit("\n"), path)
    table = table.withColumn("r_digest", digest(expression(F.col("r_host"), F.col("r_path"))))
    table = table.withColumn("key", F.substring("r_digest", 1, KEY_DIGITS))
    if not small:
        table = materialise(table, "rules")  # Spark then knows whether it is small
    odd = table.filter("r_path <> '' and not endswith(r_path, '/')").select(F.length("r_path").alias("n")).distinct()
    # lengths of rule paths that end inside a folder: as many numbers as such lengths
    lengths = sorted(r.n for r in odd.collect())
    rows = pages.select(
        "page_id",
        F.monotonically_increasing_id().alias("row"),
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
    )
    expanded = (
        rows.withColumn("suffix", F.explode(host_suffixes(F.col("host"))))
        .withColumn("prefix", F.explode(path_prefixes(F.col("path"), lengths)))
        .withColumn("digest", digest(expression(F.col("suffix"), F.col("prefix"))))
        .withColumn("key", F.substring("digest", 1, KEY_DIGITS))
    )
    weight = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("length"),
        F.length("r_host").alias("host_length"),
        (F.col("verdict") == "block").alias("blocks"),
        F.concat("r_host", "r_path").alias("rule"),
        "verdict",
    )
    hits = expanded.join(F.broadcast(table) if small else table, "key", "left")
    confirmed = F.when(F.col("digest") == F.col("r_digest"), weight)
    best = hits.groupBy("row", "page_id", "host", "path").agg(F.max(confirmed).alias("best"))
    return best.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
