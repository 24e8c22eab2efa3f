"""Wavefronts of patterns over segment graphs, many (graph, pattern) pairs in one pass.

A cell is a segment and a diagonal (place in the text less place in the pattern); what counts
is the furthest place reached on it with each number of edits. Cells of all segments of all
pairs have numbers of their own, so a front is a few flat arrays: cells, places, and where
each cell was reached from. Fronts grow, extend over matching symbols and enter successors all
pairs at once; pairs that are done leave.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from seqloom.kernels.dags import Found, Graph
from seqloom.kernels.pairs import CELLS, equal_symbols

#: Most symbols compared together while a match goes on.
WINDOW = 64
#: How a cell was reached: entering a segment, or by an edit; of equal arrivals the first counts.
ENTER, GAP_TEXT, CROSS, GAP_PATTERN = range(4)
LETTERS = ("", "I", "X", "D")


class Block:
    """All segments and patterns of the pairs of a block, in flat arrays."""

    def __init__(self, graphs: list[Graph], patterns: list[np.ndarray]) -> None:
        counts = np.array([len(g.texts) for g in graphs])
        self.pair = np.repeat(np.arange(len(graphs)), counts)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        texts = [t for g in graphs for t in g.texts]
        self.size = np.array([len(t) for t in texts], np.int64)
        self.text = np.concatenate([*texts, np.zeros(1, np.int32)])
        self.text_at = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        lengths = np.array([len(p) for p in patterns], np.int64)
        self.pattern = np.concatenate([*patterns, np.zeros(1, np.int32)])
        self.n = lengths[self.pair]
        self.pattern_at = np.concatenate([[0], np.cumsum(lengths)[:-1]])[self.pair]
        width = self.n + self.size + 1
        self.cells = int(width.sum())
        self.cell_at = np.concatenate([[0], np.cumsum(width)[:-1]]) + self.n
        self.source = np.array([not before for g in graphs for before in g.preds], bool)
        self.sink = np.zeros(len(texts), bool)
        starts, places = [], []
        for g, at in zip(graphs, self.first[:-1], strict=True):
            self.sink[at + g.sinks] = True
            from_, to = g.succs
            starts.append(from_[:-1])
            places.append(to + at)
        held = np.concatenate([[0], np.cumsum([len(p) for p in places])[:-1]]).astype(np.int64)
        self.succ_at = np.concatenate([s + h for s, h in zip(starts, held, strict=True)] + [[sum(len(p) for p in places)]])
        self.succ = np.concatenate(places).astype(np.int64) if places else np.zeros(0, np.int64)

    def extended(self, segment: np.ndarray, k: np.ndarray, place: np.ndarray, match: Callable) -> np.ndarray:
        """How far matching symbols lead from each cell; windows double while all of a window matches."""
        reach, live, window = place.copy(), np.arange(len(place)), 1
        while len(live):
            of, at = segment[live], reach[live]
            ahead = np.arange(window)
            h, v = at[:, None] + ahead, (at - k[live])[:, None] + ahead
            inside = (h < self.size[of][:, None]) & (v < self.n[of][:, None])
            text = self.text[np.where(inside, self.text_at[of][:, None] + h, 0)]
            pattern = self.pattern[np.where(inside, self.pattern_at[of][:, None] + v, 0)]
            differs = ~(inside & match(pattern, text, v, h))
            stopped = differs.any(axis=1)
            reach[live] += np.where(stopped, differs.argmax(axis=1), window)
            live, window = live[~stopped], min(2 * window, WINDOW)
        return reach

    def entered(self, segment: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(successor, row) for each of the rows whose segments are left."""
        counts = self.succ_at[segment + 1] - self.succ_at[segment]
        row = np.repeat(np.arange(len(segment)), counts)
        within = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        return self.succ[self.succ_at[segment][row] + within], rows[row]


def furthest(cell: np.ndarray, place: np.ndarray, how: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Rows that get further on their cell than any before, one for each cell."""
    row = np.flatnonzero(place > best[cell])
    row = row[np.lexsort((how[row], -place[row], cell[row]))]
    keep = np.ones(len(row), bool)
    keep[1:] = cell[row[1:]] != cell[row[:-1]]
    return row[keep]


class Fronts:
    """All cells of a block's fronts, appended front by front."""

    NAMES = ("segment", "k", "begin", "reach", "how", "parent", "score")

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.count = 0

    def add(self, *columns: np.ndarray) -> np.ndarray:
        self.parts.append(columns)
        self.count += len(columns[0])
        return np.arange(self.count - len(columns[0]), self.count)

    def joined(self) -> dict[str, np.ndarray]:
        return {n: np.concatenate([p[i] for p in self.parts]) for i, n in enumerate(self.NAMES)}


def grow(block: Block, pairs: int, match: Callable, end: str, whole: bool = False) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(all fronts, the row of ``Fronts`` in which each pair ends); a pair's last front is whole.

    A cell at the end of its text or of the pattern has no gap to open there, and what lies
    beside it is never better. With ``whole`` these neighbours are in the fronts too, so that
    they hold the furthest place of every diagonal; paths cannot be followed through them.
    """
    best = np.full(block.cells, -1, np.int64)
    last = np.full(pairs, -1, np.int64)
    fronts, score = Fronts(), 0
    segment = np.flatnonzero(block.source)
    k, place, how, parent = np.zeros_like(segment), np.zeros_like(segment), np.full_like(segment, ENTER), np.full_like(segment, -1)
    while len(segment):
        front: list[tuple[np.ndarray, ...]] = []
        while len(segment):
            cell = block.cell_at[segment] + k
            row = furthest(cell, place, how, best)
            segment, k, place, how, parent = (x[row] for x in (segment, k, place, how, parent))
            reach = block.extended(segment, k, place, match)
            best[cell[row]] = reach
            number = fronts.add(segment, k, place, reach, how, parent, np.full_like(segment, score))
            front.append((segment, k, reach, number))
            ended = reach - k == block.n[segment]
            if end != "query":
                ended &= (reach == block.size[segment]) & block.sink[segment]
            done, first = np.unique(block.pair[segment[ended]], return_index=True)
            fresh = last[done] < 0
            last[done[fresh]] = number[ended][first[fresh]]
            left = np.flatnonzero(reach == block.size[segment])
            into, rows = block.entered(segment[left], left)
            segment, k, place, how, parent = into, k[rows] - reach[rows], np.zeros_like(into), np.full_like(into, ENTER), number[rows]
        segment, k, reach, number = (np.concatenate(x) for x in zip(*front, strict=True))
        on = last[block.pair[segment]] < 0
        segment, k, reach, number = segment[on], k[on], reach[on], number[on]
        down, along = reach - k < block.n[segment], reach < block.size[segment]
        both = down & along
        v, size, n = reach - k, block.size[segment], block.n[segment]
        if whole:
            along, down = along | (v > 0), down | (reach > 0)
        place = np.concatenate([np.minimum(reach + 1, size)[along], reach[both] + 1, np.where(v < n, reach, reach - 1)[down]])
        segment = np.concatenate([segment[along], segment[both], segment[down]])
        parent = np.concatenate([number[along], number[both], number[down]])
        how = np.repeat([GAP_TEXT, CROSS, GAP_PATTERN], [along.sum(), both.sum(), down.sum()])
        k = np.concatenate([k[along] + 1, k[both], k[down] - 1])
        score += 1
    return fronts.joined(), last


def paths(block: Block, fronts: dict[str, np.ndarray], last: np.ndarray) -> list[Found]:
    """Score and path of each pair, followed back from its last cell; all pairs at once."""
    scores = fronts["score"][last].tolist()
    steps, live, at = [], np.arange(len(last)), last.copy()
    while len(live):
        steps.append((live, at))
        at = fronts["parent"][at]
        live, at = live[at >= 0], at[at >= 0]
    pair, row = (np.concatenate(x)[::-1] for x in zip(*steps, strict=True))
    order = np.argsort(pair, kind="stable")
    pair, row = pair[order], row[order]
    matched = (fronts["reach"][row] - fronts["begin"][row]).tolist()
    how, segment = fronts["how"][row].tolist(), (fronts["segment"][row] - block.first[pair]).tolist()
    found: list[Found] = [(score, []) for score in scores]
    for p, n, h, s in zip(pair.tolist(), matched, how, segment, strict=True):
        path = found[p][1]
        if h == ENTER:
            path.append([s, []])
        path[-1][1].append(LETTERS[h] + "M" * n)
    return [(score, [(s, "".join(ops)) for s, ops in path]) for score, path in found]


def portions(graphs: list[Graph], patterns: list[np.ndarray], cells: int) -> list[list[int]]:
    """Indexes of pairs, alike in size, in portions of so many cells."""
    width = [len(g.texts) * (len(p) + 1) + sum(map(len, g.texts)) for g, p in zip(graphs, patterns, strict=True)]
    out, held = [], cells
    for i in sorted(range(len(width)), key=width.__getitem__):
        if held + width[i] > cells:
            out.append([])
            held = 0
        out[-1].append(i)
        held += width[i]
    return out


def wave_all(
    graphs: list[Graph], patterns: list[np.ndarray], match: Callable = equal_symbols, end: str = "global", cells: int = CELLS
) -> list[Found]:
    """Best alignment of each pattern to its graph by wavefronts; scores are those of the table.

    ``end='query'`` ends a pair in the first front with a cell that has used up its pattern.
    """
    found: list = [None] * len(graphs)
    for part in portions(graphs, patterns, cells):
        block = Block([graphs[i] for i in part], [np.asarray(patterns[i], np.int32) for i in part])
        for i, one in zip(part, paths(block, *grow(block, len(part), match, end)), strict=True):
            found[i] = one
    return found


def wavefront_align(pattern, texts, preds, match: Callable = equal_symbols, end: str = "global") -> Found:
    """``wave_all`` of one pair."""
    return wave_all([Graph(texts, preds)], [pattern], match, end)[0]


#: Table cells of the pairs whose fronts are listed together; no front has more rows than its table cells.
LISTED_CELLS = 1 << 18


def all_front_rows(
    graphs: list[Graph], patterns: list[np.ndarray], match: Callable = equal_symbols, cells: int = LISTED_CELLS
) -> Iterator[tuple[np.ndarray, ...]]:
    """(pair, score, segment, k, reach) of all cells of all fronts up to each pair's distance, for pairs in portions."""
    parts, held = [], cells
    for i, (graph, pattern) in enumerate(zip(graphs, patterns, strict=True)):
        table = (len(pattern) + 1) * sum(len(t) + 1 for t in graph.texts)
        if held + table > cells:
            parts.append([])
            held = 0
        parts[-1].append(i)
        held += table
    for part in parts:
        block = Block([graphs[i] for i in part], [np.asarray(patterns[i], np.int32) for i in part])
        fronts, _ = grow(block, len(part), match, "global", whole=True)
        pair = block.pair[fronts["segment"]]
        yield pair + part[0], fronts["score"], fronts["segment"] - block.first[pair], fronts["k"], fronts["reach"]


def front_rows(graph: Graph, pattern: np.ndarray, match: Callable = equal_symbols) -> tuple[np.ndarray, ...]:
    """``all_front_rows`` of one pair: (score, segment, k, reach)."""
    return next(all_front_rows([graph], [pattern], match))[1:]


#: Kinds of cells of gap-affine fronts: any, within a gap along the text, within one along the pattern.
ANY, ALONG_TEXT, ALONG_PATTERN = range(3)
Cells = tuple[np.ndarray, np.ndarray, np.ndarray]
NONE: Cells = (np.zeros(0, np.int64),) * 3


def joined(parts: list[Cells]) -> Cells:
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else NONE


class AffineFronts:
    """Fronts of costs 0, 1, 2, ... of all pairs of a block, three kinds of cells each."""

    def __init__(self, block: Block, pairs: int, match: Callable) -> None:
        self.block, self.match = block, match
        self.best = np.full((3, block.cells), -1, np.int64)
        self.done = np.full(pairs, -1, np.int64)
        self.kept: list[list[Cells]] = []

    def at(self, cost: int, kind: int) -> Cells:
        """Cells of an earlier front whose pairs go on."""
        if cost < 0:
            return NONE
        cells = self.kept[cost][kind]
        on = self.done[self.block.pair[cells[0]]] < 0
        return tuple(x[on] for x in cells)

    def _further(self, kind: int, parts: list[Cells]) -> Cells:
        """The cells that get further than any of their kind before; of kind ``ANY`` after matching symbols."""
        segment, k, place = joined(parts)
        cell = self.block.cell_at[segment] + k
        row = furthest(cell, place, np.zeros_like(segment), self.best[kind])
        segment, k, place, cell = segment[row], k[row], place[row], cell[row]
        if kind == ANY:
            place = self.block.extended(segment, k, place, self.match)
        self.best[kind, cell] = place
        return segment, k, place

    def add(self, cost: int, parts: list[list[Cells]]) -> None:
        """A front from what reaches it, with all segments that it enters at the same cost."""
        block, front = self.block, [[], [], []]
        while any(len(cells[0]) for kind in parts for cells in kind):
            along_text, along_pattern = (self._further(kind, parts[kind]) for kind in (ALONG_TEXT, ALONG_PATTERN))
            fresh = [self._further(ANY, [*parts[ANY], along_text, along_pattern]), along_text, along_pattern]
            parts = [[], [], []]
            for kind, (segment, k, place) in enumerate(fresh):
                front[kind].append(fresh[kind])
                left = np.flatnonzero(place == block.size[segment])
                into, rows = block.entered(segment[left], left)
                parts[kind].append((into, k[rows] - place[rows], np.zeros_like(into)))
            segment, k, place = fresh[ANY]
            ended = block.sink[segment] & (place == block.size[segment]) & (place - k == block.n[segment])
            pair = block.pair[segment[ended]]
            self.done[pair] = np.where(self.done[pair] < 0, cost, self.done[pair])
        self.kept.append([joined(cells) for cells in front])


def affine_costs(graphs: list[Graph], patterns: list[np.ndarray], cost, match: Callable = equal_symbols, cells: int = CELLS) -> list[int]:
    """Gap-affine costs of all pairs by wavefronts; matches must be free, mismatches and extensions not."""
    if cost.match or cost.mismatch <= 0 or cost.gap_extend <= 0:
        raise ValueError("wavefronts need free matches and positive mismatch and extension")
    found = [0] * len(graphs)
    opened, extended = cost.gap_open + cost.gap_extend, cost.gap_extend
    for part in portions(graphs, patterns, cells // 3):
        block = Block([graphs[i] for i in part], [np.asarray(patterns[i], np.int32) for i in part])
        fronts = AffineFronts(block, len(part), match)
        source = np.flatnonzero(block.source)
        fronts.add(0, [[(source, np.zeros_like(source), np.zeros_like(source))], [NONE], [NONE]])
        now = 0
        while (fronts.done < 0).any():
            now += 1
            along = joined([fronts.at(now - opened, ANY), fronts.at(now - extended, ALONG_TEXT)])
            down = joined([fronts.at(now - opened, ANY), fronts.at(now - extended, ALONG_PATTERN)])
            cross = fronts.at(now - cost.mismatch, ANY)
            texts, patterns_left = lambda c: c[2] < block.size[c[0]], lambda c: c[2] - c[1] < block.n[c[0]]
            pick = lambda c, where: tuple(x[where] for x in c)
            along, down, cross = pick(along, texts(along)), pick(down, patterns_left(down)), pick(cross, texts(cross) & patterns_left(cross))
            fronts.add(now, [
                [(cross[0], cross[1], cross[2] + 1)],
                [(along[0], along[1] + 1, along[2] + 1)],
                [(down[0], down[1] - 1, down[2])],
            ])
            if now >= max(opened, cost.mismatch):
                fronts.kept[now - max(opened, cost.mismatch)] = [NONE] * 3  # no later front follows from it
        for i, score in zip(part, fronts.done.tolist(), strict=True):
            found[i] = score
    return found
