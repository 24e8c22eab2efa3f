"""Plain textbook solutions to compare with."""

import itertools


def levenshtein(a, b, same=lambda x, y: x == y):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        fresh = [i]
        for j, y in enumerate(b, 1):
            fresh.append(min(row[j] + 1, fresh[-1] + 1, row[j - 1] + (not same(x, y))))
        row = fresh
    return row[-1]


def replay(pattern, text, ops):
    """Cost of a script; fails unless it is a valid alignment of the two."""
    i = j = cost = 0
    for op in ops:
        if op in "MX":
            assert (pattern[i] == text[j]) == (op == "M")
        i += op != "I"
        j += op != "D"
        cost += op != "M"
    assert (i, j) == (len(pattern), len(text))
    return cost


def graph_paths(preds):
    """All source-to-sink paths of a graph given by predecessor lists."""

    def up(v):
        return [p + [v] for u in preds[v] for p in up(u)] if preds[v] else [[v]]

    inner = set(itertools.chain(*preds))
    return [p for v in range(len(preds)) if v not in inner for p in up(v)]


def gap_affine(a, b, x, o, e):
    far = 10**9
    H, E, G = ([[far] * (len(b) + 1) for _ in range(len(a) + 1)] for _ in range(3))
    H[0][0] = 0
    for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
        if j:
            E[i][j] = min(H[i][j - 1] + o + e, E[i][j - 1] + e)
        if i:
            G[i][j] = min(H[i - 1][j] + o + e, G[i - 1][j] + e)
        step = H[i - 1][j - 1] + (a[i - 1] != b[j - 1]) * x if i and j else far
        H[i][j] = min(H[i][j], E[i][j], G[i][j], step)
    return H[-1][-1]
