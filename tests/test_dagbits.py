"""Alignment to graphs of symbols by bits: the scores and places of the table, whatever the graph."""

from __future__ import annotations

import random

import numpy as np

from seqloom.kernels import dagbits, dags, growing


def bits_of(cells: list[int]) -> dagbits.Column:
    steps = [b - a for a, b in zip(cells, cells[1:])]
    return sum((s > 0) << i for i, s in enumerate(steps)), sum((s < 0) << i for i, s in enumerate(steps)), cells[0]


def walk(rng: random.Random, size: int) -> list[int]:
    cells = [rng.randint(0, 4)]
    for _ in range(size):
        cells.append(cells[-1] + rng.choice((-1, 0, 1)))
    return cells


def test_least_of_columns():
    rng = random.Random(91)
    for _ in range(3000):
        size = rng.randint(1, 40)
        columns = [walk(rng, size) for _ in range(rng.randint(2, 6))]
        want = bits_of([min(x) for x in zip(*columns)])
        assert dagbits.least_of(size, list(map(bits_of, columns))) == want
        assert dagbits.least(size, *map(bits_of, columns[:2])) == bits_of([min(x) for x in zip(*columns[:2])])


def test_alignments_are_those_of_the_table():
    rng = random.Random(92)
    for _ in range(150):
        count = rng.randint(1, 25)
        preds = [rng.sample(range(v), min(v, rng.choice((0, 1, 1, 1, 2, 3, 6)))) for v in range(count)]
        symbols = [rng.choice(b"ACG") for _ in range(count)]
        pattern = np.array([rng.choice(b"ACGT") for _ in range(rng.randint(1, 40))], np.int32)
        graph = dags.Graph([np.array([s], np.int32) for s in symbols], preds)
        score, path = dags.align_all([graph], [pattern])[0]
        places = [None if op == "D" else place for place, ops in path for op in ops if op != "I"]
        assert dagbits.align(symbols, preds, pattern) == (score, places)


def test_large_alignments_keep_columns_at_borders(monkeypatch):
    rng = random.Random(93)
    texts = [np.array(rng.choices(b"ACGT", k=rng.randint(20, 60)), np.int32) for _ in range(6)]
    graph, added = growing.grow(texts)
    monkeypatch.setattr(growing, "GROWN_BYTES", 0)
    other, same = growing.grow(texts)
    assert added == same and graph.aligned == other.aligned and [[graph.symbols[v] for v in path] for _, path in added] == [t.tolist() for t in texts]
