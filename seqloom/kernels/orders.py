"""Orders and heaviest paths of one graph whose nodes are numbered 0..n-1.

``preds[v]`` and ``succs[v]`` are in edge insertion order, ``peers[v]`` lists the nodes
aligned to v. These walks are sequential, in time linear in nodes and edges.
"""

from __future__ import annotations


import numpy as np


class CyclicGraph(ValueError):
    """Raised when a graph has no topological order."""


def neighbours(count, edges):
    """preds, succs and the in-edge weights from (src, dst, weight) in insertion order."""
    preds, succs, weights = ([[] for _ in range(count)] for _ in range(3))
    for src, dst, weight in edges:
        preds[dst].append(src)
        succs[src].append(dst)
        weights[dst].append(weight)
    return preds, succs, weights


def grouped(count: int, keys: np.ndarray, *values: np.ndarray) -> list[list[list[int]]]:
    """For each array of values, the values of every key 0..count-1 in their order."""
    order = np.argsort(keys, kind="stable")
    ends = np.cumsum(np.bincount(keys, minlength=count)).tolist()
    out = []
    for column in values:
        flat = column[order].tolist()
        out.append([flat[low:high] for low, high in zip([0, *ends], ends)])
    return out


def checked(order, count):
    if len(order) != count:
        raise CyclicGraph(f"{count - len(order)} nodes lie on or behind a cycle")
    return order


def newest_first(preds, succs, peers=None):
    """Always continue with the node released last; sources are released in id order.

    With ``peers`` a node waits until all nodes aligned to it are free, and the aligned
    set is released together.
    """
    left = [len(p) for p in preds]
    peers = peers or [[] for _ in preds]
    stack, order = [], []
    free = bytearray(len(preds))

    def release(v):
        if not any(left[p] for p in peers[v]):
            stack.extend([v, *peers[v]])
            for u in (v, *peers[v]):
                free[u] = 1

    for v in range(len(preds)):
        if not preds[v] and not free[v]:
            release(v)
    while stack:
        v = stack.pop()
        order.append(v)
        for w in succs[v]:
            left[w] -= 1
            if left[w] == 0:
                release(w)
    return checked(order, len(preds))


def grouped_columns(order, peers):
    """Column per node: a new one at each node whose aligned set has none yet."""
    column, fresh = {}, 0
    for v in order:
        if v not in column:
            column.update(dict.fromkeys([v, *peers[v]], fresh))
            fresh += 1
    return [column[v] for v in range(len(order))]


def aligned_depth_first(preds, peers):
    """Post-order in which a node is followed at once by the nodes aligned to it.

    Before a node come the ancestors of its aligned nodes and its own, last one first.
    """
    new, open_, placed = 0, 1, 2
    state, order = bytearray(len(preds)), []

    def ancestors(v):
        """Those before v and its aligned nodes, the first one to look at last."""
        return [*preds[v], *(u for member in peers[v] for u in preds[member])] if peers[v] else preds[v][:]

    def mark(v, how):
        state[v] = how
        for member in peers[v]:
            state[member] = how

    for root in range(len(preds)):
        if state[root] != new:
            continue
        trail, waiting = [root], [ancestors(root)]
        mark(root, open_)
        while trail:
            rest = waiting[-1]
            while rest and state[rest[-1]] == placed:
                rest.pop()
            if not rest:
                waiting.pop()
                v = trail.pop()
                order.append(v)
                order.extend(peers[v])
                mark(v, placed)
                continue
            above = rest.pop()
            if state[above] == open_:
                raise CyclicGraph(f"node {above} is its own ancestor")
            mark(above, open_)
            trail.append(above)
            waiting.append(ancestors(above))
    return order


def best_edge(v, preds, weights, scores, usable):
    """Heaviest usable in-edge; ties go to the better predecessor, then the later edge."""
    ranked = [
        (weight, scores[u], place, u)
        for place, (u, weight) in enumerate(zip(preds[v], weights[v]))
        if usable(u)
    ]
    return max(ranked, default=None)


def heaviest_path(order, preds, succs, weights):
    """Scores and the heaviest path that ends in a sink.

    A node scores its chosen edge plus the predecessor's score, a source -1. Should the
    best node not be a sink, the rivals that share its successors are set aside, all later
    nodes are scored again without them, and so on until a sink is best.
    """
    scores, chosen = [-1] * len(order), [None] * len(order)

    def settle(v, usable):
        if len(preds[v]) == 1 and usable(preds[v][0]):  # most nodes have no choice
            chosen[v] = preds[v][0]
            scores[v] = weights[v][0] + scores[chosen[v]]
            return
        best = best_edge(v, preds, weights, scores, usable)
        chosen[v] = best and best[3]
        scores[v] = -1 if best is None else best[0] + scores[best[3]]

    for v in order:
        before = preds[v]
        if len(before) == 1:
            chosen[v] = before[0]
            scores[v] = weights[v][0] + scores[before[0]]
        elif before:
            best = None
            for place, (u, weight) in enumerate(zip(before, weights[v])):
                here = (weight, scores[u], place, u)
                if best is None or here > best:
                    best = here
            chosen[v], scores[v] = best[3], best[0] + best[1]
    first_scores = list(scores)
    rank = [0] * len(order)
    for r, v in enumerate(order):
        rank[v] = r
    tip = max(order, key=scores.__getitem__)  # of equal ones the first
    while succs[tip]:
        for w in succs[tip]:
            for rival in preds[w]:
                if rival != tip:
                    scores[rival] = -1
        later = order[rank[tip] + 1 :]
        for v in later:
            settle(v, lambda u: scores[u] != -1)
        tip = max(later, key=scores.__getitem__)
    path = [tip]
    while chosen[path[-1]] is not None:
        path.append(chosen[path[-1]])
    return first_scores, path[::-1]
