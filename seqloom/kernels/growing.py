"""A partial-order graph of characters that sequences are aligned to and then added to."""

from __future__ import annotations

import gc

import numpy as np

from seqloom.kernels import dagbits, dags, orders

#: Bytes of columns that are kept for an alignment; a larger one keeps those at borders, and fills so many cells at a time.
GROWN_BYTES, GROWN_CELLS = 1 << 27, 1 << 24


class GrowingGraph:
    """Nodes by number, with their predecessors and aligned sets; memory is linear in nodes and edges."""

    def __init__(self) -> None:
        self.symbols: list[int] = []
        self.preds: list[list[int]] = []
        self.succs: list[list[int]] = []
        self.aligned: list[list[int]] = []

    def aligned_to(self, sequence: np.ndarray) -> tuple[int, list[int | None]]:
        """The edits of a sequence against the nearest way through the graph, and the node that each place is set against."""
        order = orders.newest_first(self.preds, self.succs)
        at = [0] * len(order)
        for i, v in enumerate(order):
            at[v] = i
        symbols, preds = [self.symbols[v] for v in order], [[at[u] for u in self.preds[v]] for v in order]
        if dagbits.bytes_of(len(order), len(sequence)) <= GROWN_BYTES:
            score, found = dagbits.align(symbols, preds, sequence)
            return score, [None if place is None else order[place] for place in found]
        graph = dags.Graph(list(np.array(symbols, np.int32)[:, None]), preds)
        score, path = dags.align_all([graph], [sequence], cells=GROWN_CELLS)[0]
        return score, [None if op == "D" else order[place] for place, ops in path for op in ops if op != "I"]

    def _new(self, symbol: int, beside: list[int]) -> int:
        node = len(self.symbols)
        self.symbols.append(symbol)
        self.preds.append([])
        self.succs.append([])
        self.aligned.append(list(beside))
        for other in beside:
            self.aligned[other].append(node)
        return node

    def add(self, sequence: list[int], pairs: list[int | None]) -> list[int]:
        """Lay a sequence through the graph and return its path.

        A place takes the node of its symbol in the aligned set it is set against, else it makes
        one; new nodes are numbered in the order prefix, suffix, aligned part.
        """
        used = [i for i, node in enumerate(pairs) if node is not None]
        low, high = (used[0], used[-1]) if used else (len(sequence), len(sequence) - 1)
        path: dict[int, int] = {}
        for i in [*range(low), *range(max(low, high + 1), len(sequence)), *range(low, high + 1)]:
            node = pairs[i] if low <= i <= high else None
            column = [] if node is None else [node, *self.aligned[node]]
            known = next((v for v in column if self.symbols[v] == sequence[i]), None)
            path[i] = self._new(sequence[i], column[1:] + column[:1]) if known is None else known
        nodes = [path[i] for i in range(len(sequence))]
        for a, b in zip(nodes, nodes[1:], strict=False):
            if a not in self.preds[b]:
                self.preds[b].append(a)
                self.succs[a].append(b)
        return nodes


def grow(sequences: list[np.ndarray]) -> tuple[GrowingGraph, list[tuple[int, list[int]]]]:
    """The graph of a list of sequences, each aligned to what the ones before it have made, and (score, path) of each."""
    graph, added = GrowingGraph(), []
    collecting = gc.isenabled()
    gc.disable()  # lists of numbers, that a search for cycles of objects would look at again and again
    try:
        for sequence in sequences:
            text = sequence.tolist()
            score, pairs = graph.aligned_to(sequence) if graph.symbols and text else (len(text), [None] * len(text))
            added.append((score, graph.add(text, pairs)))
    finally:
        if collecting:
            gc.enable()
    return graph, added


def fold(sequences: list[list[np.ndarray]]) -> tuple[list[GrowingGraph], list[list[tuple[int, list[int]]]]]:
    """``grow`` of several lists of sequences: graphs and, per sequence, (score, path)."""
    made = [grow(some) for some in sequences]
    return [graph for graph, _ in made], [added for _, added in made]
