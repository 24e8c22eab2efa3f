"""Tables with a row per graph, and the row tables that are views of them.

A graph of texts has a row per character, and every join or window over those rows moves them
once more. Here a graph is one row of arrays. Tables of its nodes, paths, edges and ranks are
made from that row where they are read; operators that get views of the same graphs work on
the arrays, without a shuffle. Other tables go the way of joins.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seqloom.kernels.whole import NO_RANK, Whole, code_points, star, text_of
from seqloom.session import materialise, materialise_graph

INTS, LONGS = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
LONG, INT, TEXT = T.LongType(), T.IntegerType(), T.StringType()
#: A graph as a row, besides its graph_id; ``ranks`` and ``lengths`` are those of its sequences, ``path`` has their nodes.
GRAPH = T.StructType([
    T.StructField("symbols", TEXT), *(T.StructField(c, INTS) for c in ("sizes", "peers", "ranks", "lengths", "path")),
])
#: Rows of results that leave a task together.
FLUSH_ROWS = 50_000

Walk = Callable[[Whole], list[np.ndarray]]


@dataclass(frozen=True)
class Graphs:
    """A row per graph. ``read`` makes graphs of the rows of a batch, ``walks`` are what is still to be found for each.

    ``mark`` says which graphs they are; ``made`` names all that is found, also what the table has already.
    """

    table: DataFrame
    mark: str
    read: Callable[[pa.RecordBatch], Iterator[tuple[object, Whole]]]
    walks: tuple[tuple[tuple[str, ...], Walk], ...] = ()
    made: tuple[str, ...] = ()
    stored: bool = False

    def view(self, kind: str, rows: DataFrame) -> DataFrame:
        rows._graphs = self, kind
        return rows

    def walked(self, names: list[str], walk: Walk) -> Graphs:
        """The same graphs with further arrays of numbers."""
        return replace(self, walks=(*self.walks, (tuple(names), walk)), made=(*self.made, *names), stored=False)

    def _reader(self) -> Callable[[pa.RecordBatch], Iterator[tuple[object, Whole]]]:
        read, walks = self.read, self.walks

        def graphs(batch: pa.RecordBatch) -> Iterator[tuple[object, Whole]]:
            for key, graph in read(batch):
                for names, walk in walks:
                    found = walk(graph) if graph.size else [np.zeros(0, np.int64) for _ in names]
                    graph.made.update(zip(names, found, strict=True))
                yield key, graph

        return graphs

    def written(self, label: str = "graphs") -> Graphs:
        """Rows with all that was found as a written table."""
        if self.stored:
            return self
        names, table = [name for found, _ in self.walks for name in found], self.table
        if names:
            schema, graphs = T.StructType([*table.schema.fields, *(T.StructField(c, INTS) for c in names)]), self._reader()

            def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                target = to_arrow_schema(schema)
                for batch in batches:
                    found = [[graph.made[c] for c in names] for _, graph in graphs(batch)]
                    more = [lists([f[i] for f in found], target.field(c).type) for i, c in enumerate(names)]
                    same = [batch.column(i).cast(target.field(i).type) for i in range(batch.num_columns)]
                    yield pa.RecordBatch.from_arrays([*same, *more], schema=target)

            table = table.mapInArrow(apply, schema)
        return replace(self, table=materialise(table, label), walks=(), stored=True)

    def rows(self, fields: list[T.StructField], kernel: Callable[[Whole], list], empty: bool = False) -> DataFrame:
        """graph_id and the columns that ``kernel`` gives for each graph: arrays of numbers, Arrow arrays or lists.

        Graphs without nodes have no rows, unless ``empty``.
        """
        schema, graphs = T.StructType([self.table.schema["graph_id"], *fields]), self._reader()

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = Rows(schema)
            for batch in batches:
                for key, graph in graphs(batch):
                    if graph.size or empty:
                        yield from out.add(key, kernel(graph))
            yield from out.rest()

        return self.table.mapInArrow(apply, schema)


def shared(**views: DataFrame) -> Graphs | None:
    """The graphs that all of the tables are views of, each of the kind it is named for, with all that was made of them."""
    found = [getattr(v, "_graphs", (None, "")) for v in views.values()]
    if any(g is None or kind != name for (g, kind), name in zip(found, views, strict=True)):
        return None
    most = max((g for g, _ in found), key=lambda g: len(g.made))
    alike = all(g.mark == most.mark and set(g.made) <= set(most.made) for g, _ in found)
    return most if alike else None


def renamed(rows: DataFrame, before: str, after: str) -> DataFrame:
    """``withColumnRenamed`` that leaves a view one."""
    out = rows.withColumnRenamed(before, after)
    if hasattr(rows, "_graphs"):
        out._graphs = rows._graphs
    return out


def kept(rows: DataFrame, label: str) -> DataFrame:
    """``materialise_graph``; of a view the graphs are written, and it is read from them each time."""
    if not hasattr(rows, "_graphs"):
        return materialise_graph(rows, label)
    graphs, kind = rows._graphs
    return rows if graphs.stored else VIEWS[kind](graphs.written(label))


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate([np.asarray(v, np.int64) for v in values]) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), ranked(flat).cast(kind.value_type), type=kind)


def ranked(values: np.ndarray) -> pa.Array:
    """Ranks as numbers, with the nulls among them."""
    return pa.array(values, mask=values == NO_RANK) if len(values) and values.min() == NO_RANK else pa.array(values)


def known(values: np.ndarray) -> pa.Array:
    """Numbers of which negative ones stand for a null."""
    return pa.array(values, mask=values < 0)


class Rows:
    """Rows of results, by graph, that leave in batches."""

    def __init__(self, schema: T.StructType) -> None:
        self.target = to_arrow_schema(schema)
        self.keys, self.counts, self.held = [], [], 0
        self.columns: list[list] = [[] for _ in schema.fields[1:]]

    def add(self, key, columns: list) -> Iterator[pa.RecordBatch]:
        self.keys.append(key)
        self.counts.append(len(columns[0]))
        for held, more in zip(self.columns, columns, strict=True):
            held.append(more)
        self.held += len(columns[0])
        if self.held >= FLUSH_ROWS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if sum(self.counts):
            owner = pa.array(self.keys, self.target[0].type).take(pa.array(np.repeat(np.arange(len(self.keys)), self.counts)))
            made = [self._joined(c, f.type) for c, f in zip(self.columns, list(self.target)[1:], strict=True)]
            size = len(owner)
            for low in range(0, size, FLUSH_ROWS):
                part = [c.slice(low, FLUSH_ROWS) for c in (owner, *made)]
                yield pa.RecordBatch.from_arrays(part, schema=self.target)
        for column in (self.keys, self.counts, *self.columns):
            column.clear()
        self.held = 0

    @staticmethod
    def _joined(parts: list, kind: pa.DataType) -> pa.Array:
        if isinstance(parts[0], np.ndarray):
            return pa.array(np.concatenate(parts)).cast(kind)
        if isinstance(parts[0], pa.Array):
            return pa.concat_arrays(parts).cast(kind)
        return pa.array([x for part in parts for x in part], kind)


def _arrays(batch: pa.RecordBatch, names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The arrays of every row."""
    cuts, flat = {}, {}
    for name in names:
        column = batch.column(name)
        cuts[name] = column.offsets.to_numpy().tolist()
        values = column.values.cast(pa.int64())
        flat[name] = (values.fill_null(NO_RANK) if values.null_count else values).to_numpy()
    for i in range(batch.num_rows):
        yield {n: flat[n][cuts[n][i] : cuts[n][i + 1]] for n in names}


def read_graphs(batch: pa.RecordBatch) -> Iterator[tuple[object, Whole]]:
    """Graphs of rows with the columns of ``GRAPH``."""
    own = [n for n in GRAPH.names if n != "symbols"]
    made = [n for n in batch.schema.names if n not in ("graph_id", *GRAPH.names)]
    keys, symbols = batch.column("graph_id").to_pylist(), batch.column("symbols")
    for key, text, found in zip(keys, symbols, _arrays(batch, [*own, *made]), strict=True):
        yield key, Whole(code_points(text.as_py()), *(found[n] for n in own), made={n: found[n] for n in made})


def read_stars(batch: pa.RecordBatch) -> Iterator[tuple[object, Whole]]:
    """Graphs of rows with ``sequences``, which are made anew each time: that takes less than to read what is made."""
    made = [n for n in batch.schema.names if n not in ("graph_id", "sequences")]
    keys, texts = batch.column("graph_id").to_pylist(), batch.column("sequences")
    for key, rows, found in zip(keys, texts, _arrays(batch, made), strict=True):
        rows = sorted(rows.as_py(), key=lambda r: (r["seq_rank"] is not None, r["seq_rank"] or 0))
        weights = [r["weights"] for r in rows] if rows and "weights" in rows[0] else None
        graph = star([(r["seq_rank"], r["seq"], r["runs"]) for r in rows], weights)
        graph.made = found
        yield key, graph


def packed(schema: T.StructType, named: list[tuple[object, Whole]]) -> pa.RecordBatch:
    """Graphs as rows of ``schema``: graph_id, the columns of ``GRAPH`` and what was made."""
    target, graphs = to_arrow_schema(schema), [g for _, g in named]
    columns = [pa.array([key for key, _ in named], target[0].type), pa.array([text_of(g.symbols) for g in graphs], target[1].type)]
    for f in list(target)[2:]:
        columns.append(lists([getattr(g, f.name) if f.name in GRAPH.names else g.made[f.name] for g in graphs], f.type))
    return pa.RecordBatch.from_arrays(columns, schema=target)


def star_graphs(sequences: DataFrame) -> Graphs:
    """Graphs of sequences (graph_id, seq_rank, seq, runs [, weights]), each made in one task.

    ``runs`` has what ``pairs`` has, a struct (node, pos, length) for every stretch of both that
    goes on by one. Sequences that come together by graph_id are not moved again.
    """
    weighted = [c for c in ("weights",) if c in sequences.columns]
    one = F.struct(F.col("seq_rank").cast("int").alias("seq_rank"), "seq", "runs", *weighted)
    table = sequences.filter("seq <> ''").groupBy("graph_id").agg(F.collect_list(one).alias("sequences"))
    return Graphs(table, uuid.uuid4().hex, read_stars)


def letters(graph: Whole) -> pa.Array:
    """The symbol of each node as a text."""
    data = text_of(graph.symbols).encode("utf-8", "surrogatepass")
    width = 1 + (graph.symbols >= 0x80) + (graph.symbols >= 0x800) + (graph.symbols >= 0x10000)
    offsets = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
    return pa.StringArray.from_buffers(graph.size, pa.py_buffer(offsets), pa.py_buffer(data))


def aligned(graph: Whole) -> pa.Array:
    """The aligned nodes of each node."""
    offsets = np.concatenate([[0], np.cumsum(graph.sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.asarray(graph.peers, np.int64)))


NODE = [T.StructField("node_id", LONG), T.StructField("symbol", TEXT), T.StructField("aligned", LONGS)]


def nodes(graphs: Graphs) -> DataFrame:
    return graphs.view("nodes", graphs.rows(NODE, lambda g: [np.arange(g.size), letters(g), aligned(g)]))


def paths(graphs: Graphs) -> DataFrame:
    def listed(g: Whole) -> list:
        rank, pos, node, weight = g.places
        return [ranked(rank), pos, node.astype(np.int64), weight]

    fields = [T.StructField("seq_rank", INT), T.StructField("pos", INT), T.StructField("node_id", LONG), T.StructField("weight", LONG)]
    return graphs.view("paths", graphs.rows(fields, listed))


EDGE = [T.StructField("src", LONG), T.StructField("dst", LONG), T.StructField("weight", LONG), T.StructField("ord", INT)]


def edges(graphs: Graphs) -> DataFrame:
    def listed(g: Whole) -> list:
        src, dst, weight, first = g.edges
        return [src, dst, weight, ranked(first)]

    return graphs.view("edges", graphs.rows(EDGE, listed))


def walked(graphs: Graphs, names: list[str], walk: Callable[..., list[np.ndarray]]) -> Graphs:
    """With what a walk (see ``packing.walk_graphs``) finds."""

    def apply(g: Whole) -> list[np.ndarray]:
        src, dst, weight, _ = g.edges
        return walk(np.arange(g.size), src, dst, weight, (g.sizes, g.peers))

    return graphs.walked(names, apply)


def _listed(graphs: Graphs, name: str, at: str, value: str, kind: T.DataType = INT) -> DataFrame:
    fields = [T.StructField(at, kind), T.StructField(value, LONG)]
    return graphs.rows(fields, lambda g: [np.arange(len(g.made[name])), np.asarray(g.made[name], np.int64)])


def ranks(graphs: Graphs) -> DataFrame:
    return graphs.view("ranks", _listed(graphs, "order", "rank", "node_id"))


def consensus(graphs: Graphs) -> DataFrame:
    return graphs.view("consensus", _listed(graphs, "consensus", "pos", "node_id"))


def placed(graphs: Graphs) -> DataFrame:
    return graphs.view("placed", _listed(graphs, "column", "node_id", "column", LONG))


VIEWS = {"nodes": nodes, "paths": paths, "edges": edges, "ranks": ranks, "consensus": consensus, "placed": placed}
