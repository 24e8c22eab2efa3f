"""Edit-script algebra on columns: M match, X mismatch, I consumes text, D consumes pattern."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from seqloom.kernels import scripts
from seqloom.session import kernel

OPERATIONS = "MXID"


def matches(ops: Column) -> Column:
    return F.length(F.regexp_replace(ops, "[^M]", "")).cast("long")


def edit_score(ops: Column) -> Column:
    """Number of X, I and D; null when the string holds anything that is no operation."""
    edits = F.length(F.replace(ops, F.lit("M"), F.lit(""))).cast("long")
    return F.when(ops.rlike(f"^[{OPERATIONS}]*$"), edits)


def leading(ops: Column, insertions: Column | None = None, deletions: Column | None = None) -> Column:
    """Put insertions, then in front of them deletions, before the script."""
    parts = []
    if deletions is not None:
        parts.append(F.repeat(F.lit("D"), deletions))
    if insertions is not None:
        parts.append(F.repeat(F.lit("I"), insertions))
    return F.concat(*parts, ops)


def compare(a: Column, b: Column, unit: str = "byte") -> Column:
    """Length difference; for equal lengths, difference of the first differing symbols."""
    return _each("long", lambda x, y: scripts.compare(x, y, unit))(a, b)


def run_lengths(ops: Column) -> Column:
    """array<struct<op, len>> of the runs of equal operations."""
    runs = F.regexp_extract_all(ops, F.lit(r"(M+|X+|I+|D+)"), F.lit(1))
    return F.transform(
        runs, lambda run: F.struct(F.left(run, F.lit(1)).alias("op"), F.length(run).alias("len"))
    )


def compact(ops: Column) -> Column:
    """Run-length text such as 3M1X2M."""
    return F.array_join(
        F.transform(run_lengths(ops), lambda run: F.concat(run["len"].cast("string"), run["op"])), ""
    )


def compact_path(path: Column) -> Column:
    """Run-length text of array<struct<segment, ops>>: (1)3M(3)2M."""
    return F.array_join(
        F.transform(
            path, lambda step: F.concat(F.lit("("), step["segment"].cast("string"), F.lit(")"), compact(step["ops"]))
        ),
        "",
    )


def _each(result: T.DataType | str, function: Callable) -> Callable[..., Column]:
    """A column of ``function`` over rows without a null; other rows give null."""

    def rows(columns):
        return [None if any(x is None for x in row) else function(*row) for row in zip(*columns)]

    if isinstance(result, T.StructType):

        @kernel(result)
        def whole(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            for columns in batches:
                none = (None,) * len(result.fields)
                yield pd.DataFrame([r or none for r in rows(columns)], columns=result.names)

    else:

        @kernel(result)
        def whole(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in batches:
                yield pd.Series(rows(columns), dtype=object)

    return whole


def refine(ops: Column, pattern: Column, text: Column, unit: str = "byte") -> Column:
    """Turn M into X where the symbols differ; add D, then I, for what the script left over."""
    return _each("string", lambda o, p, t: scripts.refine(o, p, t, unit))(ops, pattern, text)


def is_valid(ops: Column, pattern: Column, text: Column, unit: str = "byte") -> Column:
    """Replay: M must match, X must differ, and both strings must be used up exactly.

    The unit is that of the alignment: bytes of UTF-8, or characters.
    """
    return _each("boolean", lambda o, p, t: scripts.is_valid(o, p, t, unit))(ops, pattern, text)


ROWS = T.StructType([T.StructField(name, T.StringType()) for name in ("pattern", "ops", "text")])


def pretty(ops: Column, pattern: Column, text: Column, unit: str = "byte") -> Column:
    """struct<pattern, ops, text>: the alignment drawn as three rows.

    A bar marks a match, a space an edit, X an operation the symbols contradict and ? what
    the script leaves over. In bytes, a character that a gap tears apart is drawn as the
    replacement character.
    """
    return _each(ROWS, lambda o, p, t: scripts.pretty(o, p, t, unit))(ops, pattern, text)
