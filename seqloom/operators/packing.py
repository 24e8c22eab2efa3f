"""Whole graphs inside a task: walked over their sorted rows, or packed into one row each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

#: Rows of results that leave a walk together.
FLUSH_ROWS = 10_000


def walk_graphs(
    nodes: DataFrame, edges: DataFrame, walk: Callable[..., list], result: T.StructType, aligned: bool = True
) -> DataFrame:
    """graph_id and the columns of ``result`` from ``walk(ids, src, dst, weight, aligned)``.

    The orders that need a whole graph are sequential within it. Its rows come to one task,
    sorted, and are held there as arrays of plain numbers (8 bytes a value), so the size of a
    graph changes neither the method nor the answer. Nodes come by id, edges by ``ord``,
    ``aligned`` as the number of aligned nodes of each node and their ids in one array. A walk
    gives one list per result column.
    """
    if "aligned" not in nodes.columns:
        nodes = nodes.withColumn("aligned", F.expr("cast(array() as array<bigint>)"))
    none = F.lit(None).cast("long")
    node_rows = nodes.select(
        "graph_id", F.lit(0).alias("kind"), F.col("node_id").cast("long").alias("place"),
        none.alias("src"), none.alias("dst"), none.alias("weight"), F.col("aligned").cast("array<bigint>").alias("aligned"),
    )
    edge_rows = edges.select(
        "graph_id", F.lit(1).alias("kind"), F.col("ord").cast("long").alias("place"),
        *[F.col(c).cast("long").alias(c) for c in ("src", "dst", "weight")], F.lit(None).cast("array<bigint>").alias("aligned"),
    )
    rows = (
        node_rows.unionByName(edge_rows)
        .repartition("graph_id")
        .sortWithinPartitions("graph_id", "kind", "place", "src", "dst", "weight")
    )
    schema = T.StructType([T.StructField("graph_id", nodes.schema["graph_id"].dataType), *result.fields])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, held = _NONE, _Held()
        keys, counts, out = [], [], [[] for _ in result.fields]

        def finish() -> None:
            found = walk(*held.arrays())
            keys.append(graph)
            counts.append(len(found[0]))
            for column, more in zip(out, found, strict=True):
                column.append(np.asarray(more, dtype=np.int64))

        def flushed() -> pa.RecordBatch:
            owner = pa.array(keys, key_type).take(pa.array(np.repeat(np.arange(len(keys)), counts)))
            columns = [pa.array(np.concatenate(c)).cast(t) for c, t in zip(out, _arrow_types(result), strict=True)]
            for column in (keys, counts, *out):
                column.clear()
            return pa.RecordBatch.from_arrays([owner, *columns], names=schema.names)

        for batch in batches:
            key_type = batch.schema.field("graph_id").type
            for low, high in _runs(batch.column("graph_id")):
                part = batch.slice(low, high - low)
                key = part.column("graph_id")[0].as_py()
                if graph is _NONE or key != graph:
                    if held:
                        finish()
                    graph, held = key, _Held()
                    if sum(counts) >= FLUSH_ROWS:
                        yield flushed()
                held.add(part)
        if held:
            finish()
        if keys:
            yield flushed()

    return rows.mapInArrow(apply, schema)


_NONE = object()


class _Held:
    """Rows of one graph as they come: nodes, then edges, in pieces of plain numbers."""

    def __init__(self) -> None:
        self.ids, self.peers, self.sizes = [], [], []
        self.ends: list[list[np.ndarray]] = [[], [], []]

    def __bool__(self) -> bool:
        return bool(self.ids)

    def add(self, rows: pa.RecordBatch) -> None:
        count = int(np.searchsorted(rows.column("kind").to_numpy(), 1))  # rows are sorted by kind
        if count:
            aligned = rows.column("aligned").slice(0, count)
            self.ids.append(rows.column("place").slice(0, count).to_numpy())
            self.sizes.append(pc.fill_null(pc.list_value_length(aligned), 0).to_numpy())
            self.peers.append(aligned.flatten().to_numpy())
        if count < rows.num_rows:
            for pieces, name in zip(self.ends, ("src", "dst", "weight"), strict=True):
                pieces.append(rows.column(name).slice(count).to_numpy())

    def arrays(self) -> tuple:
        """ids, src, dst, weight, and the aligned nodes of all nodes as (sizes, ids)."""
        joined = lambda pieces: np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
        return joined(self.ids), *map(joined, self.ends), (joined(self.sizes), joined(self.peers))


def _runs(keys: pa.Array) -> Iterator[tuple[int, int]]:
    """Where runs of equal keys begin and end; null is a key."""
    size = len(keys)
    if not size:
        return
    here, before = keys.slice(1), keys.slice(0, size - 1)
    changed = pc.or_(pc.fill_null(pc.not_equal(here, before), False), pc.xor(pc.is_null(here), pc.is_null(before)))
    cuts = (np.flatnonzero(changed.to_numpy(zero_copy_only=False)) + 1).tolist()
    yield from zip([0, *cuts], [*cuts, size], strict=True)


def _arrow_types(result: T.StructType) -> list[pa.DataType]:
    known = {"bigint": pa.int64(), "int": pa.int32()}
    return [known[f.dataType.simpleString()] for f in result.fields]


def pack(nodes: DataFrame, edges: DataFrame, *node_columns: str) -> DataFrame:
    """graph_id, ids, src, dst, weight and one array per extra node column.

    Nodes are sorted by id, edges by ``ord``. Both come in through one shuffle.
    """
    wanted = ["node_id", *node_columns]
    node_rows = nodes.select("graph_id", F.struct(*wanted).alias("node"))
    edge_rows = edges.select("graph_id", F.struct("ord", "src", "dst", "weight").alias("edge"))
    return (
        node_rows.unionByName(edge_rows, allowMissingColumns=True)
        .groupBy("graph_id")
        .agg(
            F.array_sort(F.collect_list("node")).alias("node"),
            F.array_sort(F.collect_list("edge")).alias("edge"),
        )
        .select(
            "graph_id",
            F.col("node.node_id").alias("ids"),
            *[F.col(f"node.{c}").alias(c) for c in node_columns],
            *[F.col(f"edge.{c}").alias(c) for c in ("src", "dst", "weight")],
        )
    )
