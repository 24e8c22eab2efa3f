"""Alignment of sequences to directed acyclic segment graphs.

segments : graph_id, segment_id, sequence     edges : graph_id, src, dst, weight, ord
queries  : graph_id, query_id, pattern
result   : graph_id, query_id, score, path ARRAY<STRUCT<segment, ops>>, cigar

Sources are all segments without incoming edges, sinks all without outgoing ones. A graph
comes to a task once, before its queries, which are aligned in blocks of bounded size; who has
graphs too large for a task asks for method 'levels', which aligns level by level with joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seqloom.functions.cigar import compact_path
from seqloom.kernels import dags, orders, waves
from seqloom.kernels.pairs import CELLS, equal_symbols, next_column, symbols
from seqloom.operators.packing import pack
from seqloom.operators.segments import levels, sinks
from seqloom.operators.skew import spread_sides
from seqloom.session import kernel, materialise_graph

STEP = T.StructType([T.StructField("segment", T.LongType()), T.StructField("ops", T.StringType())])
FOUND = T.StructType(
    [T.StructField("score", T.LongType()), T.StructField("path", T.ArrayType(STEP))]
)
COLUMN = T.ArrayType(T.IntegerType())
#: Queries that are aligned together at most, and rows of listings that leave together.
BLOCK_QUERIES, FLUSH_ROWS = 20_000, 50_000


def align_graphs(
    queries: DataFrame,
    segments: DataFrame,
    edges: DataFrame,
    method: str = "table",
    end: str = "global",
    match: Callable = equal_symbols,
) -> DataFrame:
    """Best alignment of every query to its graph.

    method 'table' fills the dynamic-programming table, 'wavefront' grows wavefronts by
    distance, 'levels' fills the table with joins, one round per level; scores agree, equally
    good paths may differ. end='query' may stop at any point of the graph once the query is
    used up. The size of a graph never changes the method.
    """
    if method not in ("table", "wavefront", "levels") or end not in ("global", "query"):
        raise ValueError("method must be 'table', 'wavefront' or 'levels', end 'global' or 'query'")
    if method == "levels":
        found = align_by_level(queries, segments, edges, match=match, end=end)
    else:
        found = align_packed(queries, segments, edges, method=method, end=end, match=match)
    return found.withColumn("cigar", compact_path(F.col("path")))


def arranged(ids: list[int], sequences: list[str], src: list[int], dst: list[int]) -> tuple[list[int], dags.Graph]:
    """Segments in topological order: their ids, and the graph."""
    place = {v: i for i, v in enumerate(ids)}
    preds, succs, _ = orders.neighbours(len(ids), [(place[a], place[b], 1) for a, b in zip(src, dst, strict=True)])
    order = orders.newest_first(preds, succs)
    at = {v: r for r, v in enumerate(order)}
    graph = dags.Graph([symbols(sequences[v]) for v in order], [[at[u] for u in preds[v]] for v in order])
    return [ids[v] for v in order], graph


def over_graphs(
    queries: DataFrame, segments: DataFrame, edges: DataFrame, work: Callable, result: T.StructType, flat: bool = False
) -> DataFrame:
    """graph_id, query_id and ``result`` from ``work(pairs)``, for blocks of (ids, graph, pattern).

    ``work`` gives one iterable of rows per pair; with ``flat`` it gives rows of all pairs as
    arrays, the places of their pairs and then the columns of ``result``. Null patterns and queries without a graph have no result. Graph rows sort before their queries, so each
    graph is sent to a task, and brought in order there, once; a graph with very many queries
    is sent to several. A block ends when its tables reach a bound, so graphs of any number
    and queries of any number pass through a task in bounded memory.
    """
    packed = pack(segments.withColumnRenamed("segment_id", "node_id"), edges, "sequence")
    asked, graphs = spread_sides(queries.select("graph_id", "query_id", "pattern"), packed, "graph_id", "query_id")
    rows = graphs.drop("weight").unionByName(asked.filter("pattern is not null"), allowMissingColumns=True)
    met = rows.repartition("graph_id", "salt").sortWithinPartitions("graph_id", "salt", F.col("ids").isNull())
    fields = [rows.schema["graph_id"], queries.schema["query_id"], *result.fields]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        keys, pairs, out, held = [], [], [], 0
        graph_id = graph = None

        def made() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)
            out.clear()
            return batch

        def worked() -> Iterator[pa.RecordBatch]:
            for key, found in zip(keys, work(pairs), strict=True):
                for row in found:
                    out.append((*key, *row))
                    if len(out) >= FLUSH_ROWS:
                        yield made()
            keys.clear()
            pairs.clear()

        def listed() -> Iterator[pa.RecordBatch]:
            named = [pa.array(c, f.type) for c, f in zip(zip(*keys, strict=True), target)]
            for of, *columns in work(pairs):
                for low in range(0, len(of), FLUSH_ROWS):
                    owner = pa.array(of[low : low + FLUSH_ROWS])
                    made = [pa.array(c[low : low + FLUSH_ROWS], f.type) for c, f in zip(columns, list(target)[2:], strict=True)]
                    yield pa.RecordBatch.from_arrays([*(name.take(owner) for name in named), *made], schema=target)
            keys.clear()
            pairs.clear()

        finish = listed if flat else worked
        for batch in batches:
            for row in batch.to_pylist():
                if row["ids"] is not None:
                    graph_id, graph = row["graph_id"], arranged(row["ids"], row["sequence"], row["src"], row["dst"])
                    continue
                if graph is None or row["graph_id"] != graph_id:
                    continue  # a query without a graph
                pattern = symbols(row["pattern"])
                keys.append((graph_id, row["query_id"]))
                pairs.append((*graph, pattern))
                held += (len(pattern) + 1) * len(graph[1].symbol)
                if held >= CELLS or len(pairs) >= BLOCK_QUERIES:
                    yield from finish()
                    held = 0
        yield from finish()
        if out:
            yield made()

    return met.mapInArrow(apply, schema)


def align_packed(
    queries: DataFrame,
    segments: DataFrame,
    edges: DataFrame,
    method: str = "table",
    end: str = "global",
    match: Callable = equal_symbols,
) -> DataFrame:
    def best(pairs: list) -> Iterator[list[tuple]]:
        ids, graphs, patterns = zip(*pairs, strict=True) if pairs else ((), (), ())
        if method == "wavefront":
            found = waves.wave_all(graphs, patterns, match, end)
        else:
            found = dags.align_all(graphs, patterns, dags.EditCosts(match), end)
        for named, (score, path) in zip(ids, found, strict=True):
            yield [(score, [{"segment": named[i], "ops": ops} for i, ops in path])]

    return over_graphs(queries, segments, edges, best, FOUND)


CELL = T.StructType(
    [T.StructField("segment", T.LongType())]
    + [T.StructField(c, T.IntegerType()) for c in ("h", "v", "score")]
)
FRONT = T.StructType(
    [T.StructField("distance", T.IntegerType()), T.StructField("segment", T.LongType())]
    + [T.StructField(c, T.IntegerType()) for c in ("k", "reach")]
)


def table_cells(queries: DataFrame, segments: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, query_id, segment, h, v, score: the whole table over a graph, to look at.

    Columns leave as they are made, so a listing of any length needs the open columns only.
    """

    def listed(pairs: list) -> Iterator[Iterable[tuple]]:
        for ids, graph, pattern in pairs:
            yield (
                (ids[i], h, v, score)
                for i, h, column in dags.segment_tables(graph, pattern)
                for v, score in enumerate(column.tolist())
            )

    return over_graphs(queries, segments, edges, listed, CELL)


def front_cells(queries: DataFrame, segments: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, query_id, distance, segment, k, reach: the wavefronts over a graph, the last one whole."""

    def listed(pairs: list) -> Iterator[tuple[np.ndarray, ...]]:
        ids, graphs, patterns = zip(*pairs, strict=True) if pairs else ((), (), ())
        first = np.cumsum([0, *map(len, ids)])
        named = np.array([i for each in ids for i in each], np.int64)
        for pair, score, segment, k, reach in waves.all_front_rows(graphs, patterns):
            yield pair, score, named[first[pair] + segment], k, reach

    return over_graphs(queries, segments, edges, listed, FRONT, flat=True)


def segment_table(entry: list[int], pattern: np.ndarray, text: np.ndarray, match: Callable) -> np.ndarray:
    """[h, v]: the columns of one segment from its column 0."""
    columns = [np.asarray(entry, dtype=np.int32)[None, :]]
    for h in range(1, len(text) + 1):
        columns.append(next_column(columns[-1], pattern[None, :], text[None, h - 1 : h], h, match))
    return np.stack(columns)[:, 0, :]


def back_through(table: np.ndarray, v: int, h: int) -> tuple[str, int]:
    """Walk one segment's table back to its column 0: (operations, pattern position left)."""
    ops = []
    while h > 0:
        if v == 0:
            ops.append("I" * h)
            break
        here = table[h, v]
        if here == table[h, v - 1] + 1:
            ops.append("D")
            v -= 1
        elif here == table[h - 1, v] + 1:
            ops.append("I")
            h -= 1
        else:
            ops.append("M" if here == table[h - 1, v - 1] else "X")
            v, h = v - 1, h - 1
    return "".join(reversed(ops)), v


def _last_column(match: Callable):
    """Last column of a segment, and the best place in it to stop with the pattern used up."""
    ended = T.StructType([T.StructField("last", COLUMN), T.StructField("stop", T.IntegerType()), T.StructField("h", T.IntegerType())])

    @kernel(ended)
    def last(entry: pd.Series, pattern: pd.Series, text: pd.Series) -> pd.DataFrame:
        rows = []
        for column, p, t in zip(entry, pattern, text):
            table = segment_table(column, symbols(p), symbols(t), match)
            rows.append((table[-1].tolist(), int(table[:, -1].min()), int(table[:, -1].argmin())))
        return pd.DataFrame(rows, columns=["last", "stop", "h"])

    return last


def _back(match: Callable):
    walked = T.StructType([T.StructField("ops", T.StringType()), T.StructField("left", T.IntegerType())])

    @kernel(walked)
    def back(entry: pd.Series, pattern: pd.Series, text: pd.Series, v: pd.Series, h: pd.Series) -> pd.DataFrame:
        rows = []
        for column, p, t, at, stop in zip(entry, pattern, text, v, h):
            rows.append(back_through(segment_table(column, symbols(p), symbols(t)[: int(stop)], match), int(at), int(stop)))
        return pd.DataFrame(rows, columns=["ops", "left"])

    return back


def by_levels(queries: DataFrame, nodes: DataFrame, edges: DataFrame) -> Iterator[tuple[DataFrame, bool]]:
    """Per level, all (graph, query, node) rows of it; and whether it is the first level."""
    level = materialise_graph(levels(nodes, edges), "levels")
    placed = materialise_graph(nodes.join(level, ["graph_id", "node_id"]), "placed")
    asked, copies = (
        materialise_graph(side, "met")
        for side in spread_sides(
            queries.filter("pattern is not null").select("graph_id", "query_id", "pattern"), placed, "graph_id", "query_id"
        )
    )
    depth = level.agg(F.max("level")).first()[0]
    for now in range((-1 if depth is None else depth) + 1):
        yield copies.filter(F.col("level") == now).join(asked, ["graph_id", "salt"]).drop("salt"), now == 0


def cellwise_min(edges: DataFrame, here: DataFrame, done: DataFrame, arrays: list[str]) -> DataFrame:
    """graph_id, query_id, node_id and, per array, the cell-wise least over all predecessors."""
    key = ["graph_id", "query_id", "node_id"]
    cells = F.posexplode(F.arrays_zip(*arrays)).alias("v", "cell")
    return (
        edges.select("graph_id", F.col("src").alias("node_id"), "dst")
        .join(here.select("graph_id", F.col("node_id").alias("dst")), ["graph_id", "dst"], "left_semi")
        .join(done.select(*key, *arrays), ["graph_id", "node_id"])
        .select("graph_id", "query_id", F.col("dst").alias("node_id"), cells)
        .groupBy(*key, "v")
        .agg(*[F.min(f"cell.{a}").alias(a) for a in arrays])
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.struct("v", *arrays))).alias("cells"))
        .select(*key, *[F.col(f"cells.{a}").alias(a) for a in arrays])
    )


def align_by_level(
    queries: DataFrame, segments: DataFrame, edges: DataFrame, match: Callable = equal_symbols, end: str = "global"
) -> DataFrame:
    """The same table alignment as joins over (graph, query, segment) rows.

    With end='query' each level carries the best place to stop in each segment, and the best
    of all levels is the end of the path. Forward, each level takes the cell-wise minimum of its predecessors' last columns and
    passes it through its own text. Backward, each round walks one segment and joins to
    the first predecessor that explains the column. Rounds = levels of the deepest graph.
    """
    nodes = segments.withColumnRenamed("segment_id", "node_id")
    key = ["graph_id", "query_id", "node_id"]
    done = None
    for here, first in by_levels(queries, nodes, edges):
        if first:
            ready = here.withColumn("entry", F.sequence(F.lit(0), F.octet_length("pattern")))
        else:
            entry = cellwise_min(edges, here, done.withColumnRenamed("entry", "before"), ["last"])
            ready = here.join(entry.withColumnRenamed("last", "entry"), key)
        step = materialise_graph(
            ready.withColumn("end", _last_column(match)("entry", "pattern", "sequence")).select("*", "end.*").drop("end"), "columns"
        )
        done = step if done is None else done.unionByName(step)
    if done is None:
        return queries.limit(0).select(
            "graph_id", "query_id", F.lit(0).cast("long").alias("score"),
            F.lit(None).cast(T.ArrayType(STEP)).alias("path"))
    ends = done
    if end == "global":
        ends = done.join(sinks(nodes, edges).select("graph_id", "node_id"), ["graph_id", "node_id"], "left_semi")
        ends = ends.withColumns({"stop": F.element_at("last", -1), "h": F.octet_length("sequence")})
    tips = ends.groupBy("graph_id", "query_id").agg(
        F.min(F.struct(F.col("stop").alias("score"), "level", "node_id", "h")).alias("tip"),
        F.first(F.octet_length("pattern")).alias("v"),
    )
    front = materialise_graph(
        tips.select("graph_id", "query_id", F.col("tip.score").alias("score"),
                    F.col("tip.node_id").alias("node_id"), "v", F.col("tip.h").alias("from")),
        "tips",
    )
    scores = front.select("graph_id", "query_id", "score")
    steps, round_ = None, 0
    while not front.isEmpty():
        walked = materialise_graph(
            front.drop("score")
            .join(done, key)
            .withColumn("from", F.coalesce("from", F.octet_length("sequence")))
            .withColumn("w", _back(match)("entry", "pattern", "sequence", "v", "from"))
            .select(*key, "w.ops", F.col("w.left").alias("v"), F.col("entry")[F.col("w.left")].alias("cost")),
            "walked",
        )
        origin = (
            walked.select(*key, "v", "cost")
            .withColumnRenamed("node_id", "dst")
            .join(edges.select("graph_id", "src", "dst", "ord"), ["graph_id", "dst"])
            .join(
                done.select("graph_id", "query_id", F.col("node_id").alias("src"), "last"),
                ["graph_id", "query_id", "src"],
            )
            .filter(F.col("last")[F.col("v")] == F.col("cost"))
            .groupBy("graph_id", "query_id")
            .agg(F.min(F.struct("ord", "src", "v")).alias("o"))
            .select("graph_id", "query_id", F.col("o.src").alias("node_id"), F.col("o.v").alias("v"),
                    F.lit(None).cast("int").alias("from"))
        )
        front = materialise_graph(origin, "tips")
        stopped = walked.join(front.select("graph_id", "query_id", F.lit(True).alias("on")),
                              ["graph_id", "query_id"], "left")
        step = stopped.select(
            "graph_id", "query_id", F.lit(-round_).alias("at"), F.col("node_id").alias("segment"),
            F.when(F.col("on"), F.col("ops")).otherwise(
                F.concat(F.repeat(F.lit("D"), F.col("v")), "ops")).alias("ops"),
        )
        steps = step if steps is None else steps.unionByName(step)
        round_ += 1
    if steps is None:
        return scores.select("graph_id", "query_id", F.col("score").cast("long").alias("score"),
                             F.lit(None).cast(T.ArrayType(STEP)).alias("path"))
    path = steps.groupBy("graph_id", "query_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "segment", "ops"))).alias("s")
    ).select("graph_id", "query_id", F.transform(
        "s", lambda s: F.struct(s["segment"].cast("long").alias("segment"), s["ops"].alias("ops"))).alias("path"))
    return scores.join(path, ["graph_id", "query_id"]).select(
        "graph_id", "query_id", F.col("score").cast("long").alias("score"), "path"
    )


def node_graph(nodes: DataFrame) -> DataFrame:
    """Base-level nodes as one-symbol segments, so node graphs align the same way."""
    return nodes.select("graph_id", F.col("node_id").alias("segment_id"), F.col("symbol").alias("sequence"))
