"""Small arithmetic helpers as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def bounded_add(a: Column, b: Column, limit: Column) -> Column:
    return F.least(a + b, limit)


def bounded_subtract(a: Column, b: Column, limit: Column) -> Column:
    return F.greatest(a - b, limit)


def percentage(amount: Column, total: Column) -> Column:
    """100 * amount / total, 0 when there is no total."""
    return F.when(total == 0, F.lit(0.0)).otherwise(100.0 * amount / total)


def whole_quotient(a: Column, b: Column) -> Column:
    """Whole division in whole-number arithmetic, exact for all longs; null for b = 0."""
    return F.call_function("div", a.cast("long"), F.nullif(b.cast("long"), F.lit(0)))


def divide_down(a: Column, b: Column) -> Column:
    """Whole division of non-negative numbers, 0 for a zero divisor."""
    return F.when(b == 0, F.lit(0)).otherwise(whole_quotient(a, b)).cast("long")


def divide_up(a: Column, b: Column) -> Column:
    """The same rounded up; a + b may pass the largest long."""
    down = whole_quotient(a, b)
    return F.when(b == 0, F.lit(0)).otherwise(down + (a.cast("long") > down * b).cast("long")).cast("long")


def random_int(low: int, high: int, seed: int) -> Column:
    """Uniform whole number in low..high; repeatable for a fixed partitioning."""
    return (F.lit(low) + F.floor(F.rand(seed) * (high - low + 1))).cast("long")


def random_float(low: float, high: float, seed: int) -> Column:
    return F.lit(low) + F.rand(seed) * (high - low)


def pattern_row(offset: Column, diagonal: Column) -> Column:
    """v of a wavefront cell; the offset itself is h."""
    return offset - diagonal


def diagonal(h: Column, v: Column) -> Column:
    return h - v


def last_bit(value: Column) -> Column:
    return value.bitwiseAND(1)


def without_last_bit(value: Column) -> Column:
    return value.bitwiseAND(-2)


def kibibytes(size: Column) -> Column:
    """Whole KiB of a byte count; shift by ten more bits for MiB and GiB."""
    return F.shiftright(size, 10)
