"""Pairwise alignments with their edit scripts, as columns over Arrow batches.

Score alone is the built-in's job (``functions.text``); these columns are for callers who
need the operations, a band, wavefronts or their own notion of a match.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seqloom.functions.text import distance, unit_length
from seqloom.kernels import bits, pairs
from seqloom.kernels.dags import Graph, segment_tables
from seqloom.session import kernel

ALIGNMENT = T.StructType(
    [T.StructField("score", T.LongType()), T.StructField("ops", T.StringType())]
)


def _column(aligner: Callable, unit: str) -> Callable[[Column, Column], Column]:
    @kernel(ALIGNMENT)
    def aligned(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for pattern, text in batches:
            known = (pattern.notna() & text.notna()).to_numpy()
            scores, ops = aligner(
                [pairs.symbols(p, unit) for p in pattern[known]], [pairs.symbols(t, unit) for t in text[known]]
            )
            if known.all():
                yield pd.DataFrame({"score": scores, "ops": ops})
                continue
            out = pd.DataFrame({"score": pd.Series(None, range(len(known)), "Int64"), "ops": pd.Series(None, range(len(known)), "object")})
            out.loc[known, "score"], out.loc[known, "ops"] = scores, ops
            yield out

    return aligned


# table cells from which the bit-parallel distance beats the built-in one
LONG_PAIR = 1 << 14


def edit_distance(a: Column, b: Column, unit: str = "byte") -> Column:
    """Global edit distance of strings of any length.

    Short pairs stay in the built-in; only the strings of long pairs travel to Python,
    where a column of the table is one integer.
    """

    @kernel("long")
    def by_bits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series(
                [
                    None if p is None else bits.bit_distance(pairs.symbols(p, unit), pairs.symbols(t, unit))
                    for p, t in zip(left, right)
                ],
                dtype="Int64",
            )

    long_ = (a != b) & (unit_length(a, unit).cast("long") * unit_length(b, unit) >= LONG_PAIR)
    short = F.when(~long_, distance(a, b, unit))
    return F.coalesce(short, by_bits(F.when(long_, a), F.when(long_, b)))


def align(
    pattern: Column,
    text: Column,
    bandwidth: int | None = None,
    match: Callable = pairs.equal_symbols,
    unit: str = "byte",
) -> Column:
    """struct<score, ops> of the optimal global alignment; ties by D, I, M, X. Nulls for a null."""
    aligner = lambda p, t: pairs.align_pairs(p, t, match, bandwidth)
    return _column(aligner, unit)(pattern, text)


def align_wavefront(
    pattern: Column, text: Column, match: Callable = pairs.equal_symbols, unit: str = "byte"
) -> Column:
    """struct<score, ops> by wavefronts: work grows with the distance, not the product.

    ``match(p, t, v, h)`` receives arrays of pattern and text symbols and their positions
    and returns which of them match.
    """
    return _column(lambda p, t: pairs.wavefront_pairs(p, t, match), unit)(pattern, text)


def score_cells(pattern: Column, text: Column, unit: str = "byte") -> Column:
    """The score table as an array (h) of arrays (v), for inspection of short pairs."""

    @kernel(T.ArrayType(T.ArrayType(T.IntegerType())))
    def table(patterns: pd.Series, texts: pd.Series) -> pd.Series:
        rows = [
            pairs.score_table(pairs.symbols(p, unit), pairs.symbols(t, unit)).tolist()
            for p, t in zip(patterns, texts)
        ]
        return pd.Series(rows)

    return table(pattern, text)


#: Cells of a listing that leave a task together.
FLUSH_CELLS = 100_000


def score_rows(rows: DataFrame, pattern: str, text: str, unit: str = "byte") -> DataFrame:
    """The other columns of ``rows`` and h, v, score: the score table of each pair, a row per cell.

    Columns of the table leave as they are made, so a pair of any length needs two of them.
    Pairs with a null have no cells.
    """
    keys = [f for f in rows.schema.fields if f.name not in (pattern, text)]
    cells = [T.StructField(c, T.IntegerType()) for c in ("h", "v", "score")]
    schema = T.StructType([*keys, *cells])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)

        def made(row: dict, parts: list[np.ndarray]) -> pa.RecordBatch:
            h, v, score = (np.concatenate(x) for x in zip(*parts, strict=True))
            named = [pa.repeat(pa.scalar(row[f.name], target.field(f.name).type), len(h)) for f in keys]
            return pa.RecordBatch.from_arrays([*named, *(pa.array(x, pa.int32()) for x in (h, v, score))], schema=target)

        for batch in batches:
            for row in batch.to_pylist():
                if row[pattern] is None or row[text] is None:
                    continue
                graph, parts, held = Graph([pairs.symbols(row[text], unit)], [[]]), [], 0
                for _, h, column in segment_tables(graph, pairs.symbols(row[pattern], unit)):
                    parts.append((np.full(len(column), h), np.arange(len(column)), column))
                    held += len(column)
                    if held >= FLUSH_CELLS:
                        yield made(row, parts)
                        parts, held = [], 0
                if parts:
                    yield made(row, parts)

    return rows.mapInArrow(apply, schema)


def score_lines(pattern: Column, text: Column, cells: Column) -> Column:
    """A score table drawn as lines: text symbols, column numbers, then one line per row.

    Cells are five wide; scores of 10000 and more are starred.
    """
    drawn = lambda score: F.when(
        score.between(0, 9999), F.concat(F.lit(" "), F.lpad(score.cast("string"), 3, " "), F.lit(" "))
    ).otherwise("  *  ")
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    head = F.concat(
        F.lit(" " * 7), F.array_join(F.transform(letters, lambda c: F.concat(F.lit("  "), c, F.lit("  "))), "")
    )
    numbers = F.concat(F.lit(" "), F.array_join(F.transform(cells, lambda column, h: drawn(h)), ""))
    body = F.transform(
        F.sequence(F.lit(0), F.length(pattern)),
        lambda v: F.concat(
            F.when(v == 0, F.lit(" ")).otherwise(F.substr(pattern, v, F.lit(1))),
            F.array_join(F.transform(cells, lambda column: drawn(F.get(column, v))), ""),
        ),
    )
    return F.concat(F.array(head, numbers), body)


def wavefront_cells(pattern: Column, text: Column, unit: str = "byte") -> Column:
    """Furthest offset per distance and diagonal: array<struct<distance, k, reach>>."""
    cell = T.StructType([T.StructField(c, T.IntegerType()) for c in ("distance", "k", "reach")])

    def cells_of(p: str, t: str) -> list[tuple[int, int, int]]:
        (pattern_, n), (text_, m) = (pairs.padded([pairs.symbols(s, unit)], -1) for s in (p, t))
        history, _ = pairs.wavefront_history(pattern_, n, text_, m, pairs.equal_symbols, True)
        return [
            (s, k, int(offset))
            for s, (offsets, _) in enumerate(history)
            for k, offset in enumerate(offsets[0], -s)
            if offset >= 0
        ]

    @kernel(T.ArrayType(cell))
    def trace(patterns: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([cells_of(p, t) for p, t in zip(patterns, texts)])

    return trace(pattern, text)
