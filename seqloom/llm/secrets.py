"""Secret scans by a trigram inverted index.

Each rule's regular expression is turned into a Boolean trigram query: the strings that any
match must hold, as an OR of ANDs of trigrams. Postings (trigram, document) are written for
the trigrams that the rules ask for, intersected per document, and only candidates are
searched with the expression itself. Rules without mandatory trigrams search every document.
Who has many rules, or new ones from time to time, writes the postings of all trigrams once
(``write_index``); any rule is then answered from those of its own trigrams. Built-in
functions only.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from seqloom.session import materialise

#: Alternatives of a rule that are told apart; more make the query weaker, never wrong.
MOST_STRINGS = 64
#: Elements of an array whose running sums are made in one go.
SUM_BLOCK = 256


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# Fixed values. A run of one character class is matched to its end, so asking for the least
# length in the expression (access, hex) finds what a later length test would leave.
RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=12,
    ),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)


def _strings(items) -> set[str] | None:
    """All strings of a parsed expression in lower case, None if there are too many."""
    found = {""}
    for op, value in items:
        if op is sre.LITERAL:
            more = {chr(value).lower()}
        elif op is sre.IN and all(kind is sre.LITERAL for kind, _ in value):
            more = {chr(c).lower() for _, c in value}
        elif op is sre.SUBPATTERN:
            more = _strings(value[-1])
        elif op is sre.BRANCH:
            parts = [_strings(branch) for branch in value[1]]
            more = None if None in parts else set().union(*parts)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[1] == 1:
            more = _strings(value[2])
            more = more if more is None or value[0] else more | {""}
        elif op is sre.AT:
            more = {""}
        else:
            more = None
        if more is None or len(found) * len(more) > MOST_STRINGS:
            return None
        found = {a + b for a, b in product(found, more)}
    return found


def _both(left: set[frozenset], right: set[frozenset]) -> set[frozenset]:
    """AND of two queries; a clause that another one implies is dropped."""
    clauses = {a | b for a, b in product(left, right)}
    return {c for c in clauses if not any(other < c for other in clauses)}


def _query(items) -> set[frozenset]:
    query, run = {frozenset()}, []

    def close() -> None:
        nonlocal query, run
        strings = _strings(run) or {""}
        parts = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        query, run = _both(query, {c for c in parts if not any(other < c for other in parts)}), []

    for item in items:
        if _strings([*run, item]) is not None:
            run.append(item)
            continue
        close()
        op, value = item
        if op is sre.SUBPATTERN:
            query = _both(query, _query(value[-1]))
        elif op is sre.BRANCH:
            query = _both(query, set().union(*(_query(branch) for branch in value[1])))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] >= 1:
            query = _both(query, _query(value[2]))
    close()
    return query


def trigram_query(pattern: str) -> list[list[str]]:
    """OR of ANDs of lower-case trigrams that every match of the expression holds.

    Empty if some match needs none, so that the rule must search every text.
    """
    clauses = _query(sre_parser.parse(pattern))
    return [] if frozenset() in clauses else sorted(sorted(c) for c in clauses)


def postings(docs: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """(trigram, doc_id) for the wanted trigrams of each text, once per row."""
    text = F.lower("text")
    wanted = F.array(*(F.lit(t) for t in trigrams))
    return docs.withColumn("__lower", text).select(
        F.explode(F.filter(wanted, lambda t: F.contains(F.col("__lower"), t))).alias("trigram"), "doc_id"
    )


def trigrams_of(text: Column) -> Column:
    """The distinct trigrams of a text in lower case."""
    letters = F.filter(F.split(F.lower(text), ""), lambda c: c != "")
    from_ = lambda i: F.slice(letters, i, F.greatest(F.size(letters) - 2, F.lit(0)))
    joined = lambda x, y: F.zip_with(x, y, lambda a, b: F.concat(a, b))
    return F.array_distinct(joined(from_(1), joined(from_(2), from_(3))))


def write_index(docs: DataFrame, path: str) -> None:
    """Append the postings (trigram, content) of all trigrams of each distinct text to a parquet table.

    ``content`` is a hash of the text, so copies have postings once and an index outlives ids. Each
    text also has the empty trigram, which says that it is indexed. Postings are sorted by
    trigram over range partitions, a frequent one over several, so a look-up reads few row groups.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    once = docs.select(F.xxhash64(text).alias("content"), text.alias("text")).groupBy("content").agg(F.first("text").alias("text"))
    listed = F.concat(F.array(F.lit("")), trigrams_of(F.col("text")))
    rows = once.select(F.explode(listed).alias("trigram"), "content")
    rows.repartitionByRange("trigram", "content").sortWithinPartitions("trigram").write.mode("append").parquet(path)


def candidates(index: DataFrame, queries: dict[str, list[list[str]]]) -> DataFrame:
    """(doc_id, kinds): the rules whose trigram query a document's postings fulfil."""
    held = index.groupBy("doc_id").agg(F.collect_set("trigram").alias("held"))
    fits = [
        F.when(
            F.exists(
                F.array(*(F.array(*(F.lit(t) for t in clause)) for clause in clauses)),
                lambda clause: F.size(F.array_except(clause, "held")) == 0,
            ),
            F.lit(kind),
        )
        for kind, clauses in queries.items()
    ]
    return held.select("doc_id", F.array_compact(F.array(*fits)).alias("kinds")).filter(F.size("kinds") > 0)


def _scan(values: Column, start: Column) -> Column:
    first = F.struct(F.array().cast("array<long>").alias("sums"), start.alias("total"))

    def step(s: Column, x: Column) -> Column:
        sums = F.concat(s["sums"], F.array(s["total"]))
        return F.struct(sums.alias("sums"), (s["total"] + x).alias("total"))

    return F.aggregate(values, first, step, lambda s: s["sums"])


def sums_before(values: Column) -> Column:
    """Sum of all elements before each one, block by block."""
    zero = F.lit(0).cast("long")
    count = F.ceil(F.size(values) / SUM_BLOCK).cast("int")
    numbers = F.sequence(F.lit(1), F.greatest(count, F.lit(1)))
    blocks = F.transform(numbers, lambda i: F.slice(values, (i - 1) * SUM_BLOCK + 1, SUM_BLOCK))
    sums = F.transform(blocks, lambda block: F.aggregate(block, zero, lambda a, x: a + x))
    return F.flatten(F.zip_with(blocks, _scan(sums, zero), _scan))


def _spans(i: int, rule: Rule) -> Column:
    """Spans of one rule from its matches, groups, pieces and the sums before them."""
    sizes = F.zip_with(f"__p{i}", f"__m{i}", lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("m")))
    placed = F.zip_with(
        f"__s{i}",
        sizes,
        lambda s, x: F.struct((s + x["p"]).alias("start"), (s + x["p"] + x["m"]).alias("stop")),
    )
    spans = F.zip_with(
        placed,
        f"__g{i}",
        lambda x, g: F.struct(
            x["start"].alias("start"),
            F.lit(i).alias("place"),
            F.lit(rule.kind).alias("kind"),
            x["stop"].alias("stop"),
            (F.length(g) >= rule.least).alias("ok"),
        ),
    )
    return F.filter(spans, lambda x: x["ok"])


def search(docs: DataFrame, rules: Sequence[Rule], wanted: dict[str, Column]) -> DataFrame:
    """Add ``spans``: array of (start, place, kind, stop), code points, in order.

    Matches are counted off against the pieces between them, so no position is searched twice.
    """
    none = F.array().cast("array<string>")
    on = lambda kind, value: F.when(wanted[kind], value).otherwise(none)
    rows = docs.withColumns(
        {f"__m{i}": on(r.kind, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))) for i, r in enumerate(rules)}
    )
    hit = lambda i, value: F.when(F.size(f"__m{i}") > 0, value).otherwise(none)
    groups = {
        f"__g{i}": hit(i, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group))) for i, r in enumerate(rules)
    }
    pieces = {
        f"__p{i}": hit(i, F.slice(F.split("text", r.pattern, -1), 1, F.size(f"__m{i}"))) for i, r in enumerate(rules)
    }
    rows = rows.withColumns(groups | pieces)
    lengths = lambda i: F.zip_with(f"__p{i}", f"__m{i}", lambda p, m: (F.length(p) + F.length(m)).cast("long"))
    rows = rows.withColumns({f"__s{i}": sums_before(lengths(i)) for i in range(len(rules))})
    parts = [_spans(i, rule) for i, rule in enumerate(rules)]
    spans = F.array_sort(F.concat(*parts))
    made = [f"__{c}{i}" for c in "mgps" for i in range(len(rules))]
    return rows.withColumn("spans", spans).drop(*made)


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, index: DataFrame | None = None) -> DataFrame:
    """One row per input row: doc_id, text, spans (start, place, kind, stop, ok).

    Null texts are empty. Rows that repeat an id, and rows without one, share postings; as
    every candidate is searched with the expression, this can only add searches. With an
    ``index`` (a table of ``write_index``) no text is looked through for trigrams; texts that it
    does not hold are searched by every rule, so spans are the same. Further columns of
    ``docs`` are ignored; an empty table gives an empty result.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {kind: clauses for kind, clauses in queries.items() if clauses}
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    wanted = {r.kind: F.lit(True) for r in rules}
    trigrams = sorted({t for clauses in indexed.values() for clause in clauses for t in clause})
    if indexed and index is None:
        index = materialise(postings(rows, trigrams), "postings")
        found = materialise(candidates(index, indexed), "candidates").withColumnRenamed("doc_id", "__doc")
        rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("__doc")), "left").drop("__doc")
        wanted |= {kind: F.coalesce(F.array_contains("kinds", kind), F.lit(False)) for kind in indexed}
    elif indexed:
        asked = index.filter(F.col("trigram").isin(trigrams)).select("trigram", F.col("content").alias("doc_id")).distinct()
        found = materialise(candidates(asked, indexed), "candidates").withColumnRenamed("doc_id", "__content")
        held = index.filter("trigram = ''").select(F.col("content").alias("__content"), F.lit(True).alias("__held")).distinct()
        rows = rows.withColumn("__content", F.xxhash64("text")).join(held, "__content", "left").join(found, "__content", "left")
        fits = lambda kind: F.coalesce(F.array_contains("kinds", kind), F.lit(False))
        wanted |= {kind: F.col("__held").isNull() | fits(kind) for kind in indexed}
    return search(rows, rules, wanted).select("doc_id", "text", "spans")


def redacted(found: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``find_secrets`` rows with ``clean``: the text with each span replaced by ``mark``.

    Overlapping spans are replaced together.
    """
    first = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(s: Column, x: Column) -> Column:
        gap = F.col("text").substr(s["at"].cast("int") + 1, (x["start"] - s["at"]).cast("int"))
        fresh = x["start"] >= s["at"]
        return F.struct(
            F.when(fresh, F.concat(s["out"], gap, F.lit(mark))).otherwise(s["out"]).alias("out"),
            F.greatest(s["at"], x["stop"]).alias("at"),
        )

    rest = lambda s: F.concat(s["out"], F.col("text").substr(s["at"].cast("int") + 1, F.length("text")))
    return found.withColumn("clean", F.aggregate("spans", first, step, rest))


def digest_columns(found: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, a count per kind, base_sha256 and spans as one string."""
    shown = F.array_join(
        F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    counts = [count(r.kind).alias(f"n_{r.kind}") for r in rules]
    rows = found.select("doc_id", *counts, shown.alias("spans"))
    return rows.withColumn("base_sha256", F.sha2(F.encode("spans", "UTF-8"), 256))
