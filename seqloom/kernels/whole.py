"""A whole partial-order graph as arrays of plain numbers; nodes are 0..n-1, a symbol each.

What joins and windows do over rows of many graphs is done here for one graph that is at hand:
its nodes from sequences, merged edges, columns and rows of an alignment.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import numpy as np

#: Stands for a null among ranks of sequences; it sorts first, as nulls do.
NO_RANK = np.iinfo(np.int64).min
PREFIX, SUFFIX, ALIGNED = 0, 1, 2


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)


def text_of(codes: np.ndarray) -> str:
    return np.ascontiguousarray(codes, "<i4").tobytes().decode("utf-32-le", "surrogatepass")


@dataclass
class Whole:
    symbols: np.ndarray  # code point of each node
    sizes: np.ndarray  # aligned nodes of each node
    peers: np.ndarray  # their ids, node after node
    ranks: np.ndarray  # of each sequence
    lengths: np.ndarray  # of each sequence
    path: np.ndarray  # nodes of each sequence, one sequence after the other
    weights: np.ndarray | None = None  # of each place of the paths; None: 1
    made: dict[str, np.ndarray] = field(default_factory=dict)  # what walks have found

    @property
    def size(self) -> int:
        return len(self.symbols)

    @cached_property
    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """rank, pos, node, weight of every place, by rank and pos; sequences of one rank are one."""
        rank, ends = np.repeat(self.ranks, self.lengths), np.cumsum(self.lengths)
        pos = np.arange(len(rank)) - np.repeat(ends - self.lengths, self.lengths)
        weight = np.ones(len(rank), np.int64) if self.weights is None else self.weights
        if (self.ranks[1:] > self.ranks[:-1]).all():
            return rank, pos, self.path, weight
        order = np.lexsort((pos, rank))
        return rank[order], pos[order], self.path[order], weight[order]

    def runs_of_ranks(self) -> tuple[np.ndarray, np.ndarray]:
        """(rank, places) of each rank that has places."""
        rank = self.places[0]
        starts = np.flatnonzero(np.concatenate([[len(rank) > 0], rank[1:] != rank[:-1]])[: len(rank)])
        return rank[starts], np.diff(np.append(starts, len(rank)))

    @cached_property
    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """src, dst, summed weight, first ord of every edge, by ord, src and dst."""
        rank, _, node, weight = self.places
        same = rank[1:] == rank[:-1]
        src, dst = node[:-1][same].astype(np.int64), node[1:][same].astype(np.int64)
        if not len(src):
            return (np.zeros(0, np.int64),) * 4
        key, order = src * self.size + dst, rank[1:][same]
        # the first of a key, nulls last
        first = np.where(order == NO_RANK, np.iinfo(np.int64).max, order)
        by = np.argsort(key, kind="stable")
        key = key[by]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        total = np.add.reduceat((weight[:-1] + weight[1:])[same][by], starts)
        first = np.minimum.reduceat(first[by], starts)
        first = np.where(first == np.iinfo(np.int64).max, NO_RANK, first)
        by = np.argsort(first, kind="stable")
        key = key[starts][by]
        return key // self.size, key % self.size, total[by], first[by]

    def is_end(self, side: int) -> np.ndarray:
        """Which nodes no edge has as its source (side 0) or destination (side 1)."""
        out = np.ones(self.size, bool)
        out[self.edges[side]] = False
        return out

    def rank_of(self, order: np.ndarray) -> np.ndarray:
        """The place of each node in an order, -1 for one that is not there."""
        out = np.full(self.size, -1, np.int64)
        out[order] = np.arange(len(order))
        return out

    def columns(self, order: np.ndarray) -> np.ndarray:
        """Columns of an alignment: aligned nodes share one, by the first rank among them."""
        leader = np.arange(self.size)
        owner = np.repeat(leader, self.sizes)
        np.minimum.at(leader, owner, self.peers)
        first = np.full(self.size, self.size, np.int64)
        np.minimum.at(first, leader, self.rank_of(order))
        sets = np.unique(leader)
        numbered = np.empty(self.size, np.int64)
        numbered[sets[np.argsort(first[sets], kind="stable")]] = np.arange(len(sets))
        return numbered[leader]

    def rows(self, column: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """(rank, gapped row) of each rank; rows are cut or filled up to the number of columns."""
        width = int(column.max()) + 1
        rank, _, node, _ = self.places
        at, symbol, low, out = column[node], self.symbols[node], 0, []
        ranks, counts = self.runs_of_ranks()
        for count in counts.tolist():
            here, letters = at[low : low + count], symbol[low : low + count]
            low += count
            if (here[1:] <= here[:-1]).any():
                order = np.lexsort((letters, here))
                here, letters = here[order], letters[order]
            gaps = np.maximum(np.diff(here, prepend=-1) - 1, 0)
            places = np.cumsum(gaps + 1) - 1
            row = np.full(max(width, int(places[-1]) + 1), ord("-"), np.int32)
            row[places] = letters
            out.append(text_of(row[:width]))
        return ranks, out


#: Places of the other members of a set of each size, a row per member: later ones, or earlier ones, the first, later ones.
_others: dict[int, np.ndarray] = {}


def others(size: int) -> np.ndarray:
    if size not in _others:
        later = list(range(1, size))
        rows = [later, *([*later[: k - 1], 0, *later[k:]] for k in range(1, size))]
        made = np.array(rows, np.int64).reshape(size, size - 1)
        if size > 64:
            return made
        _others[size] = made
    return _others[size]


def star(sequences: list[tuple[int | None, str, list[dict] | None]], weights: list | None = None) -> Whole:
    """The graph of (rank, text, runs): every run sets ``length`` places from ``pos`` on against nodes of rank 0 from ``node`` on.

    A base takes the node of its symbol in the set it points to, else it makes one; nodes are
    numbered by rank, region (prefix, suffix, aligned) and place of the base that makes them.
    A sequence without a rank has no path; its bases that point nowhere make one set together.
    """
    codes = [code_points(text or "") for _, text, _ in sequences]
    lengths = np.array([len(c) for c in codes], np.int64)
    ranks = np.array([NO_RANK if rank is None else rank for rank, *_ in sequences], np.int64)
    symbol = np.concatenate(codes) if codes else np.zeros(0, np.int32)
    rank, ends = np.repeat(ranks, lengths), np.cumsum(lengths)
    pos = np.arange(len(symbol)) - np.repeat(ends - lengths, lengths)
    region = np.zeros(len(symbol), np.int64)
    ahead = -1 - (rank << 32) - pos
    kind = np.where(rank == 0, pos, ahead)  # the set of a base
    lost = rank == NO_RANK
    for (_, _, runs), start, end in zip(sequences, (ends - lengths).tolist(), ends.tolist(), strict=True):
        runs = [r for r in runs or () if r["length"] > 0]
        if not runs:
            continue
        refs = np.concatenate([np.arange(r["node"], r["node"] + r["length"]) for r in runs])
        low = start + runs[0]["pos"]
        high = min(start + runs[-1]["pos"] + runs[-1]["length"], end)
        region[high:end] = SUFFIX
        region[low:high] = ALIGNED
        refs = refs[: max(high - low, 0)]
        kind[low : low + len(refs)] = refs
        lost[low : low + len(refs)] = False
    # sets without a name come first; one group per set and symbol
    named = np.where(lost, 0, 1)
    kind = np.where(lost, 0, kind)
    order = np.lexsort((pos, region, rank, symbol, kind, named))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (named[order][1:] != named[order][:-1]) | (kind[order][1:] != kind[order][:-1]) | (symbol[order][1:] != symbol[order][:-1])
    maker = order[fresh]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    by = np.lexsort((pos[maker], region[maker], rank[maker]))
    node_of = np.empty(len(maker), np.int64)
    node_of[by] = np.arange(len(maker))
    sizes, peers = aligned_sets(named[maker] , kind[maker], node_of)
    kept = np.ones(len(symbol), bool) if not lost.any() else ~lost
    path = node_of[group]
    counts = np.add.reduceat(np.append(kept, False).astype(np.int64), np.minimum(ends - lengths, len(kept))) if len(lengths) else lengths
    counts = np.where(lengths > 0, counts, 0)
    weight = None
    if weights is not None:
        flat = np.ones(len(symbol), np.int64)
        for some, start, size in zip(weights, (ends - lengths).tolist(), lengths.tolist(), strict=True):
            some = [1 if w is None else w for w in (some or ())[:size]]
            flat[start : start + len(some)] = some
        weight = flat[kept]
    asked = np.argsort(ranks, kind="stable")
    if (asked[1:] < asked[:-1]).any():
        raise ValueError("sequences come by their ranks")
    return Whole(symbol[maker][by], sizes, peers, ranks, counts, path[kept], weight)


def aligned_sets(named: np.ndarray, kind: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, peers) by node, of nodes that are aligned if they share ``named`` and ``kind``."""
    order = np.lexsort((node, kind, named))
    members, count = node[order], len(node)
    new = np.ones(count, bool)
    new[1:] = (named[order][1:] != named[order][:-1]) | (kind[order][1:] != kind[order][:-1])
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, count))
    sizes = np.zeros(count, np.int64)
    sizes[members] = np.repeat(size, size) - 1
    begins = np.cumsum(sizes) - sizes
    peers = np.zeros(int(sizes.sum()), np.int64)
    for s in np.unique(size[size > 1]).tolist():
        sets = members[starts[size == s][:, None] + np.arange(s)]
        if s <= 64:
            peers[begins[sets][:, :, None] + np.arange(s - 1)] = sets[:, others(s)]
        else:
            for one in sets:
                for k, v in enumerate(one):
                    listed = one[1:] if k == 0 else np.concatenate([one[1:k], one[:1], one[k + 1 :]])
                    peers[begins[v] : begins[v] + s - 1] = listed
    return sizes, peers
