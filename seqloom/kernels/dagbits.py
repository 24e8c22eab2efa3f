"""Edit distance and script of a pattern against a graph of symbols, with one bit per table cell.

As in ``bits`` a column is two sets of bits, where the next cell down is larger (``up``) and
where it is smaller (``down``), and here its first cell besides. A column follows from the
cell-wise least of the columns before it, whose neighbouring cells differ by -1, 0 or 1 too.
Symbols match by equality.
"""

from __future__ import annotations

import numpy as np

from seqloom.kernels.bits import positions

Column = tuple[int, int, int]  # up, down, first cell


def least(size: int, one: Column, other: Column) -> Column:
    """The cell-wise least of two columns.

    Only where ``other`` is less is found cell by cell. Where that changes, the step down is
    that of ``other``, unless both columns have steps against each other; those few are looked at.
    """
    (up, down, first), (up2, down2, first2) = one, other
    width = (size + 7) // 8
    data = b"".join((up.to_bytes(width, "little"), down2.to_bytes(width, "little"), down.to_bytes(width, "little"), up2.to_bytes(width, "little")))
    flags = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little").view(np.int8)
    half = 8 * width
    gain = flags[: 2 * half] - flags[2 * half :]
    over = np.add.accumulate(gain[:half] + gain[half:], dtype=np.int64)
    less = int.from_bytes(np.packbits(over > first2 - first, bitorder="little").tobytes(), "little") & ((1 << size) - 1)
    before = less << 1 | (first > first2)
    taken, against = less | before, (less ^ before) & (up & down2 | down & up2)
    high, low = up2 & taken | up & ~taken, down2 & taken | down & ~taken
    while against:
        bit = against & -against
        against ^= bit
        at = int(over[bit.bit_length() - 1]) + first - first2
        high, low = high & ~bit, low & ~bit
        if less & bit:
            low |= bit if at == 2 else 0
        else:
            high |= bit if at == 0 else 0
    return high, low, min(first, first2)


#: From so many columns on they are written out and compared together.
FEW = 4


def least_of(size: int, columns: list[Column]) -> Column:
    """The cell-wise least of several columns."""
    width = (size + 7) // 8
    data = b"".join([x.to_bytes(width, "little") for up, down, _ in columns for x in (up, down)])
    flags = np.unpackbits(np.frombuffer(data, np.uint8).reshape(-1, width), axis=1, count=size, bitorder="little").view(np.int8)
    cells = np.cumsum(flags[::2] - flags[1::2], axis=1, dtype=np.int32)
    cells += np.array([first for *_, first in columns], np.int32)[:, None]
    first = min(first for *_, first in columns)
    steps = np.diff(cells.min(axis=0), prepend=first)
    made = [int.from_bytes(np.packbits(x, bitorder="little").tobytes(), "little") for x in (steps > 0, steps < 0)]
    return made[0], made[1], first


def beside(up: int, down: int, rise: int, fall: int) -> tuple[int, int]:
    """(up, down) of a column whose cells lie above (``rise``) or below (``fall``) those of a column, the first one above."""
    before_up, before_down = fall << 1, rise << 1 | 1  # taken away: what the cell above has gained
    odd = (up ^ down) ^ (rise ^ fall) ^ (before_up ^ before_down)
    plus, minus = up | rise | before_up, down | fall | before_down
    more = up & rise | up & before_up | rise & before_up
    less = down & fall | down & before_down | fall & before_down
    return odd & (plus & ~minus | more), odd & (minus & ~plus | less)


def align(symbols: list[int], preds: list[list[int]], pattern: np.ndarray) -> tuple[int, list[int | None]]:
    """(distance, node per place of the pattern or None) of the best way from a source to a sink.

    Nodes come in topological order. The nearest sink is the first of equal ones; on the way back
    a pattern symbol that is left out goes before a node that is, and the first of equal predecessors
    is taken.
    """
    size = len(pattern)
    full, where = (1 << size) - 1, positions(pattern)
    up, down, first, rise, fall = [full], [0], [0], [0], [0]
    inner = bytearray(len(symbols))
    entry_of: list[int | tuple] = [-1]  # what a column follows from: a column, or several
    met: dict[tuple, Column] = {}
    for symbol, before in zip(symbols, preds, strict=True):
        if len(before) == 1:
            u = before[0]
            inner[u] = 1
            came = u + 1
            a, b, c = up[came], down[came], first[came]
        elif not before:
            came, a, b, c = 0, full, 0, 0
        else:
            came = tuple(before)
            if came in met:
                a, b, c = met[came]
            else:
                for u in before:
                    inner[u] = 1
                same = entry_of[before[0] + 1]
                if all(entry_of[u + 1] == same for u in before):
                    # all follow from one column, so they are compared by what they add to it
                    r, f = full, 0
                    for u in before:
                        r &= rise[u + 1]
                        f |= fall[u + 1]
                    x, y, z = met[same] if type(same) is tuple else (up[same], down[same], first[same])
                    a, b = beside(x, y, r, f)
                    a, b, c = a & full, b & full, z + 1
                else:
                    columns = [(up[u + 1], down[u + 1], first[u + 1]) for u in before]
                    if len(columns) < FEW:
                        a, b, c = columns[0]
                        for column in columns[1:]:
                            a, b, c = least(size, (a, b, c), column)
                    else:
                        a, b, c = least_of(size, columns)
                met[came] = a, b, c
        entry_of.append(came)
        equal = where.get(symbol, 0)
        diagonal = (((equal & a) + a) ^ a) | equal
        r = b | (full & ~(diagonal | a))
        f = a & diagonal
        entering = (r << 1) | 1
        vertical = equal | b
        up.append(((f << 1) | ~(vertical | entering)) & full)
        down.append(entering & vertical & full)
        first.append(c + 1)
        rise.append(r)
        fall.append(f)

    def cell(column: int, row: int) -> int:
        mask = (1 << row) - 1
        return first[column] + (up[column] & mask).bit_count() - (down[column] & mask).bit_count()

    ends = [i + 1 for i in range(len(symbols)) if not inner[i]]
    score, t = min((cell(t, size), t) for t in ends)
    found: list[int | None] = [None] * size
    row = size
    while t > 0:
        if row and (up[t] >> (row - 1)) & 1:
            row -= 1
            continue
        cross = row and not (rise[t] >> (row - 1)) & 1
        if cross:
            row -= 1
            found[row] = t - 1
        before = preds[t - 1]
        if len(before) < 2:
            t = before[0] + 1 if before else 0
        else:
            t = min(before, key=lambda u: cell(u + 1, row)) + 1
    return score, found


def bytes_of(count: int, size: int) -> int:
    """About the memory that ``align`` takes for so many nodes and a pattern of this size."""
    return count * (4 * (32 + 4 * (size // 30 + 1)) + 120)
