"""Streamed graphs by node: few messages to the state store, and the paths of graphs held in lists."""

import random
from collections import Counter

import pandas as pd
import pytest

from seqloom.streaming import growth
from seqloom.streaming.growth import ListedNodes, NodeProcessor, path_rows, run_path_growth_by_node


class Store(dict):
    """A state that counts its messages, whatever it holds."""

    def __init__(self):
        self.messages = Counter()

    def exists(self):
        self.messages["exists"] += 1
        return () in self

    def get(self):
        return self.getValue(())

    def update(self, value):
        self.updateValue((), value)

    def containsKey(self, key):  # noqa: N802
        self.messages["contains"] += 1
        return key in self

    def getValue(self, key):  # noqa: N802
        self.messages["get"] += 1
        return self[key]

    def updateValue(self, key, value):  # noqa: N802
        self.messages["update"] += 1
        self[key] = value


class Handle:
    def __init__(self):
        self.stores = []

    def getMapState(self, *_):  # noqa: N802
        self.stores.append(Store())
        return self.stores[-1]

    getValueState = getMapState  # noqa: N815

    def messages(self):
        return sum(sum(s.messages.values()) for s in self.stores)


def sequence(rng, rank, size=16):
    pairs = [{"pos": i, "node": i} for i in range(size)] if rank else None
    return rank, "".join(rng.choices("ACGTé", k=size)), pairs


def test_a_batch_sends_few_messages():
    rng, handle, processor = random.Random(51), Handle(), NodeProcessor()
    processor.init(handle)
    listed = ListedNodes([], [])
    for ranks in ([0, 1], [2, 3, 4], [5, 6, 7]):
        arrived = [sequence(rng, rank) for rank in ranks]
        frame = pd.DataFrame([(7, *a) for a in arrived], columns=["graph_id", "seq_rank", "seq", "pairs"])
        before = handle.messages()
        (found,) = processor.handleInputRows((7,), iter([frame.iloc[1:], frame.iloc[:1]]), None)
        assert list(found.itertuples(index=False, name=None)) == path_rows(7, arrived, listed)
        assert handle.messages() - before <= 6


@pytest.mark.parametrize("block", [1, 5, 64])
def test_graphs_of_many_blocks(monkeypatch, block):
    monkeypatch.setattr(growth, "BLOCK", block)
    rng, handle, processor = random.Random(52), Handle(), NodeProcessor()
    processor.init(handle)
    graphs = {g: ListedNodes([], []) for g in (None, 3, (1 << 53) + 1)}
    for rank in range(12):
        for part in ([None], [3, (1 << 53) + 1]):
            arrived = {g: [sequence(rng, rank, rng.choice([0, 1, 40]) if rank else 40)] for g in part}
            for rows in arrived.values():
                rows[0] = (*rows[0][:2], rows[0][2] and rows[0][2][: len(rows[0][1])])
            frame = pd.DataFrame([(g, *a) for g, rows in arrived.items() for a in rows], columns=["graph_id", "seq_rank", "seq", "pairs"])
            (found,) = processor.handleInputRows((0,), iter([frame]), None)
            want = [r for g in part for r in path_rows(g, arrived[g], graphs[g])]
            assert [r[1:] for r in found.itertuples(index=False, name=None)] == [r[1:] for r in want]
            assert [None if pd.isna(g) else g for g in found["graph_id"]] == [r[0] for r in want]
    entries = handle.stores[0]
    for g, listed in graphs.items():
        count = -(-len(listed.symbols) // block)
        assert "".join(entries[g, b][0] for b in range(count)) == "".join(listed.symbols)
        assert [near for b in range(count) for near in entries[g, b][1]] == listed.aligned
        assert entries[g, 0][2] == len(listed.symbols)


def test_streams_of_graphs_that_share_a_part(spark, monkeypatch):
    monkeypatch.setattr(growth, "PARTS", 2)
    rng, schema = random.Random(53), "graph_id long, seq_rank int, seq string, pairs array<struct<node: int, pos: int>>"
    big = 1 << 60
    rows = [(g, *sequence(rng, rank)) for g in (None, 0, 1, 2, big, big + 1) for rank in range(5)]
    want = set()
    for g in (None, 0, 1, 2, big, big + 1):
        want |= set(path_rows(g, [r[1:] for r in rows if r[0] == g], ListedNodes([], [])))
    goes = [[r for r in rows if r[1] in ranks] for ranks in ({0, 1}, {2}, {3, 4})]
    found = run_path_growth_by_node([spark.createDataFrame(go, schema) for go in goes]).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)
