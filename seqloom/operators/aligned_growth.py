"""Partial-order graphs grown by aligning each sequence to the graph so far and adding it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from seqloom.kernels.growing import grow
from seqloom.kernels.pairs import symbols
from seqloom.kernels.whole import NO_RANK, Whole
from seqloom.operators import whole
from seqloom.operators.pograph import PoGraph
from seqloom.session import materialise

#: Tasks a core that graphs are dealt to, whatever the size of their texts: aligning is far dearer than reading.
TASKS_PER_CORE = 8
#: Characters of grown graphs that leave a task together.
FLUSH_SYMBOLS = 200_000


def aligned_growth(sequences: DataFrame) -> tuple[PoGraph, DataFrame]:
    """(graph, scores) of sequences (graph_id, seq_rank, seq).

    The first sequence of a graph is a chain. Each further one, by seq_rank, is aligned over
    characters to any source-to-sink path of what is there: a base that is set against a node takes
    the node of its symbol in that node's aligned set, or makes one; other bases make nodes of
    their own. ``scores`` (graph_id, seq_rank, score) has the edits of each alignment; the
    first sequence, and one that meets an empty graph, has its length. Null and empty sequences
    add nothing and have 0. Sequences of one rank come by their text. Rows of a graph are sorted into one
    task and held there, linear in its size; a grown graph is a row of arrays, and the tables are views of it.
    """
    text = F.coalesce(F.col("seq"), F.lit("")).alias("seq")
    rows = sequences.select("graph_id", F.col("seq_rank").cast("int").alias("seq_rank"), text)
    tasks = TASKS_PER_CORE * sequences.sparkSession.sparkContext.defaultParallelism
    ordered = rows.repartition(tasks, "graph_id").sortWithinPartitions("graph_id", "seq_rank", "seq")
    kind = T.StructField("graph_id", sequences.schema["graph_id"].dataType)
    schema = T.StructType([kind, *whole.GRAPH.fields, T.StructField("scores", whole.INTS)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("graph_id", "seq_rank", "seq")), strict=True))
        done, held = [], 0
        for key, same in groupby(each, key=lambda r: r[0]):
            found = list(same)
            done.append((key, grown([rank for _, rank, _ in found], [symbols(seq, "char") for *_, seq in found])))
            held += len(done[-1][1].path)
            if held >= FLUSH_SYMBOLS:
                yield whole.packed(schema, done)
                done, held = [], 0
        if done:
            yield whole.packed(schema, done)

    made = materialise(ordered.mapInArrow(apply, schema), "grown")
    graphs = whole.Graphs(made, uuid.uuid4().hex, whole.read_graphs, made=("scores",), stored=True)
    fields = [T.StructField("seq_rank", T.IntegerType()), T.StructField("score", T.LongType())]
    return PoGraph.of(graphs), graphs.rows(fields, lambda g: [whole.ranked(g.ranks), g.made["scores"]], empty=True)


def grown(ranks: list[int | None], sequences: list[np.ndarray]) -> Whole:
    """The graph of sequences of one key, in order, with the score of each."""
    graph, added = grow(sequences)
    return Whole(
        np.array(graph.symbols, np.int32),
        np.array([len(peers) for peers in graph.aligned], np.int64),
        np.array([v for peers in graph.aligned for v in peers], np.int64),
        np.array([NO_RANK if rank is None else rank for rank in ranks], np.int64),
        np.array([len(path) for _, path in added], np.int64),
        np.array([v for _, path in added for v in path], np.int64),
        made={"scores": np.array([score for score, _ in added], np.int64)},
    )
