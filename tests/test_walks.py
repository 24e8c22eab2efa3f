"""Walks over whole graphs held as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from seqloom.kernels import orders
from seqloom.operators import packing, ranking


def test_grouped_lists_are_those_of_neighbours():
    edges = [(0, 2, 5), (1, 2, 1), (0, 1, 2), (2, 4, 3), (1, 4, 1)]
    src, dst, weight = np.array(edges, np.int64).T
    preds, weights = orders.grouped(5, dst, src, weight)
    (succs,) = orders.grouped(5, src, dst)
    assert (preds, succs, weights) == orders.neighbours(5, edges)


def test_runs_hold_null_keys_apart():
    assert list(packing._runs(pa.array([None, None, 3, 3, 4], pa.int64()))) == [(0, 2), (2, 4), (4, 5)]
    assert list(packing._runs(pa.array([], pa.int64()))) == []


def test_an_edge_to_an_unknown_node_is_an_error():
    with pytest.raises(KeyError):
        ranking._places(np.array([0, 1, 4]), np.array([4, 3]))


def test_ranks_and_consensus_of_one_walk(spark):
    edge = "graph_id long, src long, dst long, weight long, ord long"
    edges = spark.createDataFrame([(1, 0, 1, 2, 0), (1, 0, 3, 5, 1), (1, 3, 2, 1, 1), (1, 1, 2, 2, 0), (2, 4, 7, 1, 0)], edge)
    nodes = spark.createDataFrame(
        [(1, 0, []), (1, 1, [3]), (1, 2, []), (1, 3, [1]), (2, 4, []), (2, 7, [])], "graph_id long, node_id long, aligned array<long>"
    )
    ranks, path = ranking.ranks_and_consensus(nodes, edges)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(ranks) == rows(ranking.ranks(nodes, edges))
    assert rows(path) == rows(ranking.consensus(nodes, edges))
    assert ranks.columns == ["graph_id", "rank", "node_id"] and path.columns == ["graph_id", "pos", "node_id"]
