"""Differences between the vocabularies of sources, over hash-consed segment trees.

Terms are counted by (lang, source) in Arrow batches and Spark aggregates. The terms that enough
documents of a language hold are dealt to blocks of term ids; in a block, each source is a
segment tree over the ids whose leaves are its counts. Trees are hash-consed: equal subtrees of
any sources, most of all those without any count, are one node. Two trees are walked together,
and what a pair of nodes adds to the distance of two sources is worked out once and remembered.
Blocks bound what a task holds, and sums over blocks make the distances.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from seqloom.llm.common import shuffle_parts, text_bytes, word_blocks
from seqloom.session import materialise

#: A term is kept that so many documents of its language hold.
LEAST_DOCUMENTS = 30
#: Shares are whole numbers of this unit, smoothed by so much a term.
UNIT, SMOOTH = 1_000_000_000, 5
#: Rank up to which terms are listed.
TOP = 50
#: Term ids of a block (expected number).
BLOCK_TERMS = 2048
#: Different terms that a task counts before it passes them on.
FLUSH = 150_000

#: Bytes that are no part of a term become spaces, A-Z become a-z; all of UTF-8 above ASCII stays.
TERM_BYTES = bytes(
    c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents, counted in tasks before they are summed."""
    names = ["lang", "source", "term", "n", "d"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, tuple[Counter, Counter]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in groups.items():
                columns = [[lang] * len(n), [source] * len(n), n.keys(), n.values(), [d[t] for t in n]]
                types = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                arrays[2] = arrays[2].cast(pa.string())
                yield pa.RecordBatch.from_arrays(arrays, names=names)
            groups.clear()

        held = 0
        for batch in batches:
            keys = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
            for key, text in zip(keys, text_bytes(batch.column("text")), strict=True):
                n, d = groups.setdefault(key, (Counter(), Counter()))
                before, distinct = len(n), set()
                for words in word_blocks(text.translate(TERM_BYTES)):
                    n.update(words)
                    distinct.update(words)
                d.update(distinct)
                held += len(n) - before
                if held > FLUSH:
                    yield from flushed()
                    held = 0
        yield from flushed()

    counted = docs.mapInArrow(apply, "lang string, source string, term string, n long, d long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


class Forest:
    """Hash-consed segment trees over positions 0 to size - 1; a node is a number."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.ids: dict[object, int] = {}
        self.parts: list[object] = []
        self.zeros: dict[int, int] = {}

    def _node(self, part: object) -> int:
        found = self.ids.get(part)
        if found is None:
            found = self.ids[part] = len(self.parts)
            self.parts.append(part)
        return found

    def _zero(self, size: int) -> int:
        found = self.zeros.get(size)
        if found is None:
            half = size // 2
            found = self.zeros[size] = self._node(0 if size == 1 else (self._zero(half), self._zero(size - half)))
        return found

    def tree(self, counts: list[tuple[int, int]]) -> int:
        """The root for sorted (position, count); other positions have none."""
        return self._build(counts, 0, len(counts), 0, self.size)

    def _build(self, counts: list[tuple[int, int]], a: int, b: int, low: int, size: int) -> int:
        if a == b:
            return self._zero(size)
        if size == 1:
            return self._node(counts[a][1])
        half = size // 2
        cut = a
        while cut < b and counts[cut][0] < low + half:
            cut += 1
        return self._node((self._build(counts, a, cut, low, half), self._build(counts, cut, b, low + half, size - half)))

    def distance(self, a: int, b: int, share_a, share_b, known: dict[tuple[int, int], int]) -> int:
        """Sum over all positions of the differences of the leaves' shares; ``known`` holds what equal node pairs add."""
        found = known.get((a, b))
        if found is None:
            x, y = self.parts[a], self.parts[b]
            if isinstance(x, int):
                found = abs(share_a(x) - share_b(y))
            else:
                found = self.distance(x[0], y[0], share_a, share_b, known) + self.distance(x[1], y[1], share_a, share_b, known)
            known[a, b] = found
        return found


def share(total: int, terms: int):
    """Share of a count in a group with so many occurrences of kept terms, as a whole number."""
    whole = total + SMOOTH * terms
    return lambda count: 1 + UNIT * (count + SMOOTH) // whole


def share_column(count: Column, total: Column, terms: Column) -> Column:
    """``share`` in exact arithmetic."""
    part = (count + SMOOTH).cast("decimal(38,0)") * F.lit(UNIT)
    return (F.lit(1) + F.call_function("div", part, (total + SMOOTH * terms).cast("decimal(20,0)"))).cast("long")


def block_distances(blocks: DataFrame) -> DataFrame:
    """(lang, source, item, value): sums over the blocks of a task.

    ``blocks`` has for each block a row per source of its language without a term, with the
    source's total and the number of the language's kept terms, and a row per count.
    """
    names = ["lang", "source", "item", "value"]

    def priced(lang: str, rows: list[tuple], sums: dict[tuple, int]) -> None:
        counts: dict[str, list[tuple[int, int]]] = {}
        totals = {}
        held: Counter = Counter()
        for source, term, n, total, terms in rows:
            if term is None:
                totals[source], counts[source] = (total, terms), []
            else:
                held[term] += 1
        # terms that few sources hold lie together, so their empty ranges are shared
        ids = {term: i for i, (term, _) in enumerate(sorted(held.items(), key=lambda x: (-x[1], x[0])))}
        for source, term, n, _, _ in rows:
            if term is not None:
                counts[source].append((ids[term], n))
        forest = Forest(len(ids))
        roots = {source: forest.tree(sorted(of)) for source, of in counts.items()}
        shares = {whole: share(*whole) for whole in set(totals.values())}
        known: dict[tuple, dict] = {}
        order = sorted(roots)
        for i, a in enumerate(order):
            for b in order[i + 1 :]:
                whole = totals[a], totals[b]
                memo = known.setdefault(whole, {})
                value = forest.distance(roots[a], roots[b], shares[whole[0]], shares[whole[1]], memo)
                sums[lang, a, b] = sums.get((lang, a, b), 0) + value

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, sums = None, [], {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("lang", "block", "source", "term", "n", "total", "terms")]
            for lang, block, *row in zip(*columns, strict=True):
                if (lang, block) != key:
                    if rows:
                        priced(key[0], rows, sums)
                    key, rows = (lang, block), []
                rows.append(row)
        if rows:
            priced(key[0], rows, sums)
        pairs = [(lang, *pair, value) for (lang, *two), value in sums.items() for pair in (two, two[::-1])]
        for start in range(0, len(pairs), 10_000):
            columns = zip(*pairs[start : start + 10_000], strict=True)
            types = [pa.string()] * 3 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return blocks.mapInArrow(apply, "lang string, source string, item string, value long")


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) that occurs.

    Part ``pair`` has every other source of the language, with the summed differences of the
    shares of all kept terms; part ``term`` the ``top`` terms whose share exceeds that in the
    whole language most. Ranks start at 1, larger values first, then by item. Null text, lang
    and source are empty strings. A language without a kept term has distances of 0 and no
    terms. Rows that repeat an id, or have none, count like any other; further columns are
    ignored. An empty table gives an empty result.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(empty("lang"), empty("source"), empty("text"))
    named = Window.partitionBy("lang", "term")
    held = term_counts(rows).withColumns({"all_n": F.sum("n").over(named), "all_d": F.sum("d").over(named)})
    kept = materialise(held.filter(F.col("all_d") >= least).drop("d", "all_d"), "kept-terms")
    groups = rows.select("lang", "source").distinct()
    of_langs = kept.groupBy("lang").agg(F.countDistinct("term").alias("terms"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    grouped = groups.join(totals, ["lang", "source"], "left").join(of_langs, "lang", "left")
    whole = materialise(grouped.select("lang", "source", zero("total"), zero("terms"), zero("lang_total")), "groups")

    n_blocks = F.ceil(F.col("terms") / BLOCK_TERMS)
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
    sized = whole.select("lang", n_blocks.alias("blocks")).distinct()
    data = kept.join(sized, "lang").select(
        "lang", block, "source", "term", "n", F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("terms")
    )
    # each block has a row per source of its language: (lang, source) times blocks
    marks = whole.filter("terms > 0").select(
        "lang",
        F.explode(F.sequence(F.lit(0), (n_blocks - 1).cast("int"))).alias("block"),
        "source",
        F.lit(None).cast("string").alias("term"),
        F.lit(0).cast("long").alias("n"),
        "total",
        "terms",
    )
    dealt = data.unionAll(marks).repartition(shuffle_parts(docs), "lang", "block").sortWithinPartitions("lang", "block", F.col("term").asc_nulls_first())
    sums = block_distances(dealt).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    others = groups.withColumnRenamed("source", "item")
    pairs = groups.join(others, "lang").filter("source <> item").join(sums, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    p = share_column(F.col("n"), F.col("total"), F.col("terms"))
    q = share_column(F.col("all_n"), F.col("lang_total"), F.col("terms"))
    over = kept.join(whole, ["lang", "source"]).filter("n > 0").withColumn("value", p - q).filter("value > 0")
    terms = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.col("item").cast("binary"))
    rank = F.row_number().over(order).alias("rank")
    listed = terms.select("*", rank).filter(F.col("rank") <= top)
    return pairs.select("*", rank).unionAll(listed)
