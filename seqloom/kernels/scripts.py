"""Edit scripts replayed over strings in linear time, one string pair at a time.

Symbols are bytes or characters. Every operation but I uses up a pattern symbol, every one
but D a text symbol, so places are running counts.
"""

from __future__ import annotations

import numpy as np

from seqloom.kernels.pairs import symbols

INSERT, DELETE, MATCH, DIFFER = (np.uint8(ord(c)) for c in "IDMX")
NO_SYMBOL = -1


def places(ops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pattern and text place before each operation."""
    p, t = (ops != INSERT).astype(np.int64), (ops != DELETE).astype(np.int64)
    return np.cumsum(p) - p, np.cumsum(t) - t


def at(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Symbols at the places; NO_SYMBOL behind the end."""
    padded = np.append(values, NO_SYMBOL)
    return padded[np.minimum(place, len(values))]


def _read(ops: str, pattern: str, text: str, unit: str):
    codes = np.frombuffer(ops.encode("ascii", "replace"), np.uint8)
    p, t = symbols(pattern, unit), symbols(text, unit)
    v, h = places(codes)
    return codes, p, t, v, h


def is_valid(ops: str, pattern: str, text: str, unit: str) -> bool:
    codes, p, t, v, h = _read(ops, pattern, text, unit)
    if not np.isin(codes, (INSERT, DELETE, MATCH, DIFFER)).all():
        return False
    if (codes != INSERT).sum() != len(p) or (codes != DELETE).sum() != len(t):
        return False
    both = (codes == MATCH) | (codes == DIFFER)
    return bool(((at(p, v) == at(t, h)) == (codes == MATCH))[both].all())


def refine(ops: str, pattern: str, text: str, unit: str) -> str:
    codes, p, t, v, h = _read(ops, pattern, text, unit)
    inside = (v < len(p)) & (h < len(t))
    codes = codes[inside].copy()
    differ = at(p, v[inside]) != at(t, h[inside])
    codes[(codes == MATCH) & differ] = DIFFER
    left = len(p) - int((codes != INSERT).sum()), len(t) - int((codes != DELETE).sum())
    return codes.tobytes().decode() + "D" * left[0] + "I" * left[1]


def _text(values: np.ndarray, unit: str) -> str:
    if unit == "byte":
        return values.astype(np.uint8).tobytes().decode("utf-8", "replace")
    return values.astype("<u4").tobytes().decode("utf-32-le")


def pretty(ops: str, pattern: str, text: str, unit: str) -> tuple[str, str, str]:
    codes, p, t, v, h = _read(ops, pattern, text, unit)
    rows = []
    for values, place, gap in ((p, v, INSERT), (t, h, DELETE)):
        drawn = np.where(codes == gap, ord("-"), at(values, place))
        used = int((codes != gap).sum())
        rows.append(_text(np.concatenate([drawn[drawn != NO_SYMBOL], values[used:]]), unit))
    same = at(p, v) == at(t, h)
    edit = (codes == INSERT) | (codes == DELETE)
    sign = np.where(same == (codes == MATCH), np.where(codes == MATCH, ord("|"), ord(" ")), ord("X"))
    sign = np.where(edit, ord(" "), sign).astype(np.uint8).tobytes().decode()
    over = max(len(p) - int((codes != INSERT).sum()), len(t) - int((codes != DELETE).sum()), 0)
    return rows[0], sign + "?" * over, rows[1]


def compare(a: str, b: str, unit: str) -> int:
    x, y = symbols(a, unit), symbols(b, unit)
    if len(x) != len(y):
        return len(x) - len(y)
    differ = np.flatnonzero(x != y)
    return int(x[differ[0]]) - int(y[differ[0]]) if len(differ) else 0


def star_pairs(ops: str) -> list[dict]:
    """One aligned pair per operation: the pattern place unless I, the text place unless D."""
    codes = np.frombuffer(ops.encode(), np.uint8)
    v, h = places(codes)
    return [
        {"node": None if c == INSERT else int(a), "pos": None if c == DELETE else int(b)}
        for c, a, b in zip(codes, v, h, strict=True)
    ]
