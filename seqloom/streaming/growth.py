"""Graphs that grow with a stream of sequences.

Position-wise graphs only need counters, so they are an ordinary streaming aggregation.
Graphs whose alignments name nodes keep the nodes of each graph as keyed state.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seqloom.session import shared_folder

STEP_KEY = ["graph_id", "pos", "src_symbol", "dst_symbol"]


def position_steps(sequences: DataFrame) -> DataFrame:
    """graph_id, pos, src_symbol, dst_symbol: every step of every sequence; row-local."""
    letters = F.filter(F.split("seq", ""), lambda c: c != "")
    steps = F.zip_with(
        F.slice(letters, 1, F.greatest(F.length("seq") - 1, F.lit(0))),
        F.slice(letters, 2, F.length("seq")),
        lambda a, b: F.struct(a.alias("src_symbol"), b.alias("dst_symbol")),
    )
    return sequences.select("graph_id", F.posexplode(steps).alias("pos", "step")).select(
        "graph_id", "pos", "step.*"
    )


def growing_edges(sequences: DataFrame) -> DataFrame:
    """Edge weights of the position-wise graphs; works on streams and tables alike."""
    return position_steps(sequences).groupBy(*STEP_KEY).agg(
        F.sum(F.lit(2).cast("long")).alias("weight"), F.count("*").alias("sequences")
    )


def run_edge_growth(sequences: DataFrame) -> DataFrame:
    """Run the stream over what is available and return the latest weight of every edge.

    Every epoch writes the edges it changed to its own folder, so a repeated epoch
    replaces its earlier attempt.
    """
    spark = sequences.sparkSession
    base = f"{shared_folder(spark)}/growth-{uuid.uuid4().hex}"

    def save(changed: DataFrame, epoch: int) -> None:
        changed.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(
            f"{base}/edges/batch={epoch}"
        )

    _finish(growing_edges(sequences), base, "update", save)
    changes = spark.read.parquet(f"{base}/edges")
    return changes.groupBy(*STEP_KEY).agg(
        F.max_by("weight", "epoch").alias("weight"), F.max_by("sequences", "epoch").alias("sequences")
    )


def _finish(stream: DataFrame, base: str, mode: str, save) -> None:
    (
        stream.writeStream.outputMode(mode)
        .foreachBatch(save)
        .option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


PATH = "graph_id bigint, seq_rank int, pos int, node_id bigint"
COLUMNS = ["graph_id", "seq_rank", "pos", "node_id"]
STATE = "symbols string, aligned array<array<bigint>>"


class ListedNodes:
    """All nodes of a graph, held in lists."""

    def __init__(self, symbols: list[str], aligned: list[list[int]]) -> None:
        self.symbols, self.aligned = symbols, aligned

    def symbol(self, node: int) -> str:
        return self.symbols[node]

    def peers(self, node: int) -> list[int]:
        return self.aligned[node]

    def add(self, symbol: str, near: list[int]) -> int:
        """A new node, in the aligned set of those near it."""
        node = len(self.symbols)
        self.symbols.append(symbol)
        self.aligned.append([*near[1:], *near[:1]])
        for other in near:
            self.aligned[other].append(node)
        return node


class StoredNodes:
    """Nodes of a graph that lie in a state store; only those asked for are read, only those changed are written."""

    def __init__(self, store: Any, size: int) -> None:
        self.store, self.size = store, size
        self.held: dict[int, tuple[str, list[int]]] = {}
        self.changed: set[int] = set()

    def _node(self, node: int) -> tuple[str, list[int]]:
        if node not in self.held:
            symbol, aligned = self.store.getValue((node,))
            self.held[node] = symbol, [int(n) for n in aligned]
        return self.held[node]

    def symbol(self, node: int) -> str:
        return self._node(node)[0]

    def peers(self, node: int) -> list[int]:
        return self._node(node)[1]

    def add(self, symbol: str, near: list[int]) -> int:
        node = self.size
        self.size += 1
        self.held[node] = symbol, [*near[1:], *near[:1]]
        for other in near:
            self.peers(other).append(node)
        self.changed.update([node, *near])
        return node

    def save(self) -> None:
        for node in self.changed:
            self.store.updateValue((node,), self.held[node])


#: Nodes that lie in one entry of a state store, and parts in which graphs come to it.
BLOCK, PARTS = 64, 1024
ENTRY = f"{STATE}, nodes bigint"


class NodeBlocks:
    """The nodes of a graph as ``StoredNodes`` asks for them, in a map from (graph, block) to ``BLOCK`` nodes.

    Every access to a map state is a message to the JVM and an answer, which costs more than
    a block does; so each block met is read and written once. The first one knows how many
    ``nodes`` the graph has.
    """

    def __init__(self, entries: Any, graph_id: int | None) -> None:
        self.entries, self.graph_id, self.size = entries, graph_id, 0
        self.held: dict[int, dict[int, tuple[str, list[int]]]] = {}
        self.changed: set[int] = set()
        if entries.containsKey((graph_id, 0)):
            self.size = self._read(0)
        self.written = -(-self.size // BLOCK)

    def _read(self, number: int) -> int:
        symbols, aligned, size = self.entries.getValue((self.graph_id, number))
        self.held[number] = dict(enumerate(zip(symbols, aligned, strict=True)))
        return int(size)

    def _block(self, number: int) -> dict[int, tuple[str, list[int]]]:
        if number not in self.held:
            if number < self.written:
                self._read(number)
            else:
                self.held[number] = {}
        return self.held[number]

    def getValue(self, key: tuple[int]) -> tuple[str, list[int]]:  # noqa: N802
        number, at = divmod(key[0], BLOCK)
        return self._block(number)[at]

    def updateValue(self, key: tuple[int], value: tuple[str, list[int]]) -> None:  # noqa: N802
        number, at = divmod(key[0], BLOCK)
        self._block(number)[at] = value
        self.changed.add(number)

    def save(self, size: int) -> None:
        for number in self.changed | ({0} if size != self.size else set()):
            nodes = [self.held[number][at] for at in range(len(self.held[number]))]
            entry = "".join(symbol for symbol, _ in nodes), [near for _, near in nodes], size
            self.entries.updateValue((self.graph_id, number), entry)


def thread(seq: str, pairs: Any, nodes: ListedNodes | StoredNodes) -> list[int]:
    """Lay one sequence through a graph, adding the nodes it lacks; returns its path."""
    used = [(p["pos"], p["node"]) for p in ([] if pairs is None else pairs) if not pd.isna(p["pos"])]
    refs = {int(pos): int(node) for pos, node in used if not pd.isna(node)}
    first, last = (int(used[0][0]), int(used[-1][0])) if used else (len(seq), len(seq))
    path: dict[int, int] = {}
    for pos in [*range(first), *range(last + 1, len(seq)), *range(first, min(last + 1, len(seq)))]:
        ref = refs.get(pos)
        near = [] if ref is None else [ref, *nodes.peers(ref)]
        known = next((node for node in near if nodes.symbol(node) == seq[pos]), None)
        path[pos] = nodes.add(seq[pos], near) if known is None else known
    return [path[pos] for pos in range(len(seq))]


def laid(graph_id: int, arrived: pd.DataFrame, nodes: ListedNodes | StoredNodes) -> pd.DataFrame:
    """Rows of ``PATH`` of the sequences that arrived, in their order."""
    arrived = arrived.sort_values("seq_rank")
    return pd.DataFrame(path_rows(graph_id, zip(arrived["seq_rank"], arrived["seq"], arrived["pairs"]), nodes), columns=COLUMNS)


def path_rows(graph_id: int | None, arrived: Iterable[tuple], nodes: ListedNodes | StoredNodes) -> list[tuple]:
    return [
        (graph_id, int(rank), pos, node)
        for rank, seq, pairs in arrived
        for pos, node in enumerate(thread(seq, pairs, nodes))
    ]


def _grow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    symbols, aligned = "", []
    if state.exists:
        symbols, aligned = state.get
    nodes = ListedNodes(list(symbols), [[int(n) for n in near] for near in aligned])
    found = laid(key[0], pd.concat(list(batches)), nodes)
    state.update(("".join(nodes.symbols), nodes.aligned))
    yield found


class NodeProcessor(StatefulProcessor):
    """Graphs of a part as one map of ``NodeBlocks``; a batch reads and writes only blocks of nodes it meets."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "graph_id bigint, block bigint", ENTRY)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        arrived = pd.concat(list(rows)).sort_values(["graph_id", "seq_rank"])
        ids = [None if pd.isna(g) else int(g) for g in arrived["graph_id"]]
        found = []
        for graph_id, of in groupby(zip(ids, arrived["seq_rank"], arrived["seq"], arrived["pairs"]), itemgetter(0)):
            blocks = NodeBlocks(self.entries, graph_id)
            nodes = StoredNodes(blocks, blocks.size)
            found += path_rows(graph_id, (row[1:] for row in of), nodes)
            nodes.save()
            blocks.save(nodes.size)
        yield pd.DataFrame(found, columns=COLUMNS)

    def close(self) -> None:
        pass


#: The state store that keeps a key's map entry by entry.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def growing_paths_by_node(sequences: DataFrame) -> DataFrame:
    """As ``growing_paths``, with state per ``BLOCK`` nodes, so a batch touches state in proportion to what arrives.

    Graphs come to the state in ``PARTS`` parts, as a call for each graph costs more than its
    rows do. Needs the store ``ROCKSDB`` when the stream starts.
    """
    # no graph shares its part with rows without one: a null would turn the ids beside it into floats
    part = F.coalesce(F.when(F.col("graph_id").isNotNull(), F.pmod(F.xxhash64("graph_id"), F.lit(PARTS))), F.lit(-1))
    return sequences.withColumn("__part", part).groupBy("__part").transformWithStateInPandas(
        NodeProcessor(), outputStructType=PATH, outputMode="append", timeMode="none"
    )


def growing_paths(sequences: DataFrame) -> DataFrame:
    """Paths of arriving sequences through graphs kept as state, one state per graph.

    Sequences of a graph must arrive in seq_rank order across batches. Edges, ranks and
    consensus follow from the paths as in ``operators.pograph``.
    """
    return sequences.groupBy("graph_id").applyInPandasWithState(
        _grow, PATH, STATE, "append", GroupStateTimeout.NoTimeout
    )


def run_path_growth(sequences: DataFrame) -> DataFrame:
    spark = sequences.sparkSession
    base = f"{shared_folder(spark)}/growth-{uuid.uuid4().hex}"

    def save(added: DataFrame, epoch: int) -> None:
        added.write.mode("overwrite").parquet(f"{base}/paths/batch={epoch}")

    _finish(growing_paths(sequences), base, "append", save)
    added = spark.read.parquet(f"{base}/paths")
    return added.select("graph_id", "seq_rank", "pos", "node_id")


def run_path_growth_in_steps(arrivals: list[DataFrame], grow: Callable[[DataFrame], DataFrame] = growing_paths) -> DataFrame:
    """Each table arrives after the ones before it have been worked off.

    The stream is stopped and started again in between, so every graph goes on from the
    state in the checkpoint.
    """
    spark = arrivals[0].sparkSession
    base = f"{shared_folder(spark)}/growth-{uuid.uuid4().hex}"
    incoming = f"{base}/incoming"

    def save(added: DataFrame, epoch: int) -> None:
        added.write.mode("overwrite").parquet(f"{base}/paths/batch={epoch}")

    for rows in arrivals:
        rows.write.mode("append").parquet(incoming)
        stream = spark.readStream.schema(rows.schema).parquet(incoming)
        _finish(grow(stream), base, "append", save)
    return spark.read.parquet(f"{base}/paths").select("graph_id", "seq_rank", "pos", "node_id")


def run_path_growth_by_node(arrivals: list[DataFrame]) -> DataFrame:
    """``run_path_growth_in_steps`` with state by node; the session's state store is set back afterwards."""
    conf, name = arrivals[0].sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, ROCKSDB)
    try:
        return run_path_growth_in_steps(arrivals, growing_paths_by_node)
    finally:
        if before is None:
            conf.unset(name)
        else:
            conf.set(name, before)


def stream_of(spark: SparkSession, written: DataFrame, files_per_batch: int = 4) -> DataFrame:
    """A stream over the files of a written table."""
    folder = written.inputFiles()[0].rsplit("/", 1)[0]
    return (
        spark.readStream.schema(written.schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )
