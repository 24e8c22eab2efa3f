"""Edit distance and edit script with one bit per table cell.

Neighbouring cells of the table differ by -1, 0 or 1, so a column is two bit sets: where
the next cell down is larger (``up``) and where it is smaller (``down``). A whole column
advances with a handful of operations on Python's arbitrary-length integers, which makes
this the fast way for long strings; symbols must match by equality.
"""

from __future__ import annotations

import numpy as np

BLOCK_BITS = 1 << 30  # bits of columns kept for one backward pass


def positions(pattern: np.ndarray) -> dict[int, int]:
    """symbol -> bit set of the pattern positions that hold it."""
    return {
        int(symbol): int.from_bytes(np.packbits(pattern == symbol, bitorder="little").tobytes(), "little")
        for symbol in np.unique(pattern)
    }


def columns(where: dict[int, int], size: int, text: list[int], border: tuple[int, int]):
    """From the column ``border`` on, yield per symbol: up, down, rise, fall.

    rise and fall tell where the new column lies above and below the one before it.
    """
    full = (1 << size) - 1
    up, down = border
    for symbol in text:
        equal = where.get(symbol, 0)
        diagonal = (((equal & up) + up) ^ up) | equal
        rise = down | (full & ~(diagonal | up))
        fall = up & diagonal
        # row 0 rises by one from column to column
        entering = (rise << 1) | 1
        vertical = equal | down
        up = ((fall << 1) | ~(vertical | entering)) & full
        down = entering & vertical & full
        yield up, down, rise, fall


def bit_distance(a: np.ndarray, b: np.ndarray) -> int:
    rows, text = (a, b) if len(a) >= len(b) else (b, a)
    if len(text) == 0:
        return len(rows)
    last, score = len(rows) - 1, len(rows)
    start = ((1 << len(rows)) - 1, 0)
    for _, _, rise, fall in columns(positions(rows), len(rows), text.tolist(), start):
        score += (rise >> last) - (fall >> last)
    return score


def bit_align(pattern: np.ndarray, text: np.ndarray) -> tuple[int, str]:
    """(distance, operations), ties by D, I, M, X.

    The longer string lies along the bits. Columns are kept for one block at a time; the
    columns at block borders are remembered, so a block is made when the walk enters it.
    """
    upright = len(pattern) >= len(text)
    rows, cols = (pattern, text) if upright else (text, pattern)
    where, symbols, size = positions(rows), cols.tolist(), len(rows)
    stride = max(1, BLOCK_BITS // (2 * max(size, 1)))
    borders = [((1 << size) - 1, 0)]
    for low in range(0, len(symbols) - stride, stride):
        for up, down, _, _ in columns(where, size, symbols[low : low + stride], borders[-1]):
            pass
        borders.append((up, down))
    r, c, ops = size, len(symbols), []
    while r > 0 and c > 0:
        low = (c - 1) // stride * stride
        block = [(up, rise) for up, _, rise, _ in columns(where, size, symbols[low:c], borders[low // stride])]
        while r > 0 and c > low:
            up, rise = block[c - low - 1]
            bit = r - 1
            first, second = (up, rise) if upright else (rise, up)
            if (first >> bit) & 1:
                ops.append("D")
                r, c = (bit, c) if upright else (r, c - 1)
            elif (second >> bit) & 1:
                ops.append("I")
                r, c = (r, c - 1) if upright else (bit, c)
            else:
                c -= 1
                ops.append("M" if (where.get(symbols[c], 0) >> bit) & 1 else "X")
                r = bit
    left = "D" * r + "I" * c if upright else "I" * r + "D" * c
    script = left + "".join(reversed(ops))
    return len(script) - script.count("M"), script
