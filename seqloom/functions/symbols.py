"""Symbol classes and codes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# The symbols of each class.
CLASSES = {
    "digit": DIGITS,
    "letter": LOWER + LOWER.upper(),
    "alphanumeric": DIGITS + LOWER + LOWER.upper(),
    "hex_digit": DIGITS + "abcdefABCDEF",
    "eol": "\n",
    "any_eol": "\n\r",
    "end_of_record": "\n\0",
    "end_of_field": "\n\0 \t",
}

# Base codes; every other symbol is 4.
BASES = {"A": 0, "C": 1, "G": 2, "T": 3}
OTHER_BASE = 4


def is_class(symbol: Column, name: str) -> Column:
    return (F.length(symbol) == 1) & F.contains(F.lit(CLASSES[name]), symbol)


def count_class(text: Column, name: str) -> Column:
    """How many symbols of a text are in the class."""
    return (F.length(text) - F.length(F.translate(text, CLASSES[name], ""))).cast("long")


def base_index(symbol: Column) -> Column:
    """A, C, G, T in either case -> 0..3, anything else 4; raw codes 0-3 stand for themselves."""
    code = F.when(F.ascii(symbol).between(0, 3) & (F.length(symbol) == 1), F.ascii(symbol))
    for base, index in BASES.items():
        code = code.when(F.upper(symbol) == base, F.lit(index))
    return code.otherwise(F.lit(OTHER_BASE)).cast("long")


def digit(symbol: Column) -> Column:
    return (F.ascii(symbol) - F.ascii(F.lit("0"))).cast("long")


def hex_digit(symbol: Column) -> Column:
    return F.conv(symbol, 16, 10).cast("long")
