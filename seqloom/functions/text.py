"""Distances between two string columns with Spark's own edit distance.

The unit is the UTF-8 byte unless ``unit='char'`` is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def in_unit(text: Column, unit: str = "byte") -> Column:
    """The text with one character per counted unit."""
    if unit == "char":
        return text
    if unit != "byte":
        raise ValueError(f"unit must be 'byte' or 'char', not {unit!r}")
    # pure ASCII text already has one byte per character and needs no decoding
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(
        F.decode(text.cast("binary"), "ISO-8859-1")
    )


def unit_length(text: Column, unit: str = "byte") -> Column:
    return F.octet_length(text) if unit == "byte" else F.char_length(text)


def distance(a: Column, b: Column, unit: str = "byte") -> Column:
    """Global edit distance as LONG; equal strings never reach the table."""
    full = F.levenshtein(in_unit(a, unit), in_unit(b, unit))
    return F.when(a == b, F.lit(0)).otherwise(full).cast("long")


def distance_within(a: Column, b: Column, limit: int, unit: str = "byte") -> Column:
    """The distance where it is at most ``limit``, else null.

    The length difference is a lower bound, so it is tested first; what is left uses the
    banded form of the built-in, which gives up once the limit is passed.
    """
    near = F.abs(unit_length(a, unit) - unit_length(b, unit)) <= limit
    banded = F.levenshtein(in_unit(a, unit), in_unit(b, unit), limit)
    return F.when(a == b, F.lit(0)).when(near, F.nullif(banded, F.lit(-1))).cast("long")


#: Elements up to which running minima are made one by one; copying what is done is cheap until then.
SHORT_ROW = 512


def running_least(cells: Column) -> Column:
    """Least of each element and all before it, in as many passes as the length has binary digits."""
    shifts = F.filter(F.array(*(F.lit(1 << i) for i in range(31))), lambda k: k < F.size(cells))
    return F.aggregate(
        shifts,
        cells,
        lambda done, k: F.transform(done, lambda cell, j: F.when(j >= k, F.least(cell, F.get(done, j - k))).otherwise(cell)),
    )


def distance_by_fold(a: Column, b: Column) -> Column:
    """The same distance as a fold with one row of the table as its state (linear space).

    A row follows from the one above: costs of arriving from above and diagonally, then the
    step to the right. The latter runs along a short row; of a long one it is the running least
    of cost less place, in whole-array passes. Works on characters; wrap the inputs in
    ``in_unit`` for bytes.
    """
    first_row = F.sequence(F.lit(0), F.length(b))
    letters = lambda text: F.filter(F.split(text, ""), lambda c: c != "")

    def arriving(row: Column, symbol: Column) -> Column:
        diagonal = F.zip_with(
            F.slice(row, 1, F.length(b)), letters(b), lambda up_left, c: up_left + F.when(c == symbol, 0).otherwise(1)
        )
        return F.zip_with(F.slice(row, 2, F.length(b)), diagonal, lambda up, cross: F.least(up + 1, cross))

    def cell_by_cell(row: Column, symbol: Column) -> Column:
        return F.aggregate(
            arriving(row, symbol),
            F.array(row[0] + 1),
            lambda done, cell: F.concat(done, F.array(F.least(cell, F.element_at(done, -1) + 1))),
        )

    def by_passes(row: Column, symbol: Column) -> Column:
        sloped = F.transform(F.concat(F.array(row[0] + 1), arriving(row, symbol)), lambda cell, j: cell - j)
        return F.transform(running_least(sloped), lambda cell, j: cell + j)

    fold = lambda step: F.aggregate(letters(a), first_row, step, lambda row: F.element_at(row, -1).cast("long"))
    return F.when(F.length(b) <= SHORT_ROW, fold(cell_by_cell)).otherwise(fold(by_passes))
