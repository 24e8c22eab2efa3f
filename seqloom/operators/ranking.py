"""Topological orders, MSA columns and heaviest-bundle consensus of graphs of any size."""

from __future__ import annotations

import gc
from collections.abc import Callable
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, types as T

from seqloom.kernels import orders
from seqloom.operators import whole
from seqloom.operators.by_level import heaviest_by_level, set_ranks
from seqloom.operators.packing import walk_graphs
from seqloom.session import materialise_graph


def _result(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


def _places(ids: np.ndarray, named: np.ndarray) -> np.ndarray:
    """Where the named nodes stand in the sorted ids."""
    at = np.searchsorted(ids, named)
    unknown = ids[np.minimum(at, len(ids) - 1)] != named
    if unknown.any():
        raise KeyError(f"node {named[unknown][0]} is not in the graph")
    return at


class _Lists:
    """Nodes renumbered 0..n-1 by id, with lists of their neighbours as the walks expect them; those not asked for are not made."""

    def __init__(self, ids, src, dst, weight, aligned) -> None:
        if len(ids) and (ids[0] != 0 or ids[-1] != len(ids) - 1):
            src, dst, peers = _places(ids, src), _places(ids, dst), _places(ids, aligned[1])
        else:
            src, dst, peers = (_known(len(ids), x) for x in (src, dst, aligned[1]))
        self.count, self.src, self.dst, self.weight, self.aligned = len(ids), src, dst, weight, (aligned[0], peers)

    @cached_property
    def preds(self) -> list[list[int]]:
        return orders.grouped(self.count, self.dst, self.src)[0]

    @cached_property
    def succs(self) -> list[list[int]]:
        return orders.grouped(self.count, self.src, self.dst)[0]

    @cached_property
    def weights(self) -> list[list[int]]:
        return orders.grouped(self.count, self.dst, self.weight)[0]

    @cached_property
    def peers(self) -> list[list[int]]:
        sizes, peers = self.aligned
        return orders.grouped(self.count, np.repeat(np.arange(self.count), sizes), peers)[0]

    def ordered(self, order: str) -> list[int]:
        if order == "newest":
            return orders.newest_first(self.preds, self.succs)
        if order == "grouped":
            return orders.newest_first(self.preds, self.succs, self.peers)
        if order == "depth":
            return orders.aligned_depth_first(self.preds, self.peers)
        raise ValueError(f"unknown order {order!r}")

    def heaviest(self, order: list[int]) -> tuple[list[int], list[int]]:
        return orders.heaviest_path(order, self.preds, self.succs, self.weights)


def _known(count: int, named: np.ndarray) -> np.ndarray:
    """Names of nodes that are numbered 0..count-1 already."""
    if len(named) and (named.min() < 0 or named.max() >= count):
        raise KeyError(f"node {named[(named < 0) | (named >= count)][0]} is not in the graph")
    return named


def _unhindered(walk: Callable[..., list]) -> Callable[..., list]:
    """Without the search for cycles of objects, which looks at all lists of a graph again and again; they hold numbers."""

    def walked(*rows) -> list:
        was = gc.isenabled()
        gc.disable()
        try:
            return walk(*rows)
        finally:
            if was:
                gc.enable()

    return walked


def ranks(nodes: DataFrame, edges: DataFrame, order: str = "depth") -> DataFrame:
    """graph_id, rank, node_id.

    newest  : continue with the node released last
    grouped : the same, releasing aligned nodes together
    depth   : ancestors first, aligned nodes next to each other
    level   : by the longest path from a source, aligned nodes next to each other
    The first three are sequential within a graph: each graph is walked in one task, in time
    and memory linear in its rows, whatever its size. ``level`` is made with joins only, a
    round per level, for those who ask for it; no order is ever put in place of another.
    """
    if order == "level":
        return set_ranks(nodes, edges)

    @_unhindered
    def walk(ids, *rows):
        found = ids[_Lists(ids, *rows).ordered(order)]
        return [np.arange(len(found)), found]

    graphs = whole.shared(nodes=nodes, edges=edges)
    if graphs is not None:
        return whole.ranks(whole.walked(graphs, ["order"], lambda *rows: walk(*rows)[1:]))
    return walk_graphs(nodes, edges, walk, _result(rank=T.IntegerType(), node_id=T.LongType()))


def released_columns(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, node_id, column: MSA columns in the order aligned sets are released."""

    @_unhindered
    def walk(ids, *rows):
        lists = _Lists(ids, *rows)
        return [ids, orders.grouped_columns(lists.ordered("grouped"), lists.peers)]

    return walk_graphs(nodes, edges, walk, _result(node_id=T.LongType(), column=T.IntegerType()))


def consensus(nodes: DataFrame, edges: DataFrame, order: str = "depth") -> DataFrame:
    """graph_id, pos, node_id along the heaviest bundle; orders as in ``ranks``.

    Of nodes with the same score the first in the order ends the bundle.
    """
    if order == "level":
        return heaviest_by_level(nodes, edges)[1]

    @_unhindered
    def walk(ids, *rows):
        lists = _Lists(ids, *rows)
        _, path = lists.heaviest(lists.ordered(order))
        return [np.arange(len(path)), ids[path]]

    graphs = whole.shared(nodes=nodes, edges=edges)
    if graphs is not None:
        return whole.consensus(whole.walked(graphs, ["consensus"], lambda *rows: walk(*rows)[1:]))
    return walk_graphs(nodes, edges, walk, _result(pos=T.IntegerType(), node_id=T.LongType()))


def ranks_and_consensus(nodes: DataFrame, edges: DataFrame, order: str = "depth") -> tuple[DataFrame, DataFrame]:
    """``ranks`` and ``consensus`` from one walk, for callers that need both; a written table, or views of the graphs."""
    if order == "level":
        return ranks(nodes, edges, order), consensus(nodes, edges, order)

    @_unhindered
    def walk(ids, *rows):
        lists = _Lists(ids, *rows)
        found = lists.ordered(order)
        _, path = lists.heaviest(found)
        pos = np.full(len(ids), -1)
        pos[path] = np.arange(len(path))
        return [np.arange(len(found)), ids[found], pos[found]]

    def both(*rows) -> list:
        _, found, pos = walk(*rows)
        on = np.flatnonzero(pos >= 0)
        return [found, found[on[np.argsort(pos[on])]]]

    graphs = whole.shared(nodes=nodes, edges=edges)
    if graphs is not None:
        made = whole.walked(graphs, ["order", "consensus"], both)
        return whole.ranks(made), whole.consensus(made)
    walked = walk_graphs(nodes, edges, walk, _result(rank=T.IntegerType(), node_id=T.LongType(), pos=T.IntegerType()))
    made = materialise_graph(walked, "walked")
    return made.select("graph_id", "rank", "node_id"), made.filter("pos >= 0").select("graph_id", "pos", "node_id")


def consensus_scores(nodes: DataFrame, edges: DataFrame, order: str = "depth") -> DataFrame:
    """graph_id, node_id, score: path weight of each node before any branch completion."""
    if order == "level":
        return heaviest_by_level(nodes, edges)[0]

    @_unhindered
    def walk(ids, *rows):
        lists = _Lists(ids, *rows)
        scores, _ = lists.heaviest(lists.ordered(order))
        return [ids, scores]

    return walk_graphs(nodes, edges, walk, _result(node_id=T.LongType(), score=T.LongType()))
