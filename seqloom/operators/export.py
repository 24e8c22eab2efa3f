"""Graphs as text lines (GFA, DOT, plain dump), ordered by key columns.

Every function returns graph_id, section, major, minor, detail, line. Sorting by these keys gives
the file; ``write_lines`` does so with one range-sorted text output per call.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from seqloom.kernels.whole import Whole
from seqloom.operators import whole
from seqloom.operators.segments import merge_edges
from seqloom.session import materialise_graph

KEYS = ["graph_id", "section", "major", "minor", "detail"]

# Node colours by base; any other symbol is gray.
COLOURS = {
    "A": "lightskyblue",
    "C": "salmon",
    "G": "lightgoldenrod",
    "T": "limegreen",
    "N": "gray",
    "S": "thistle",
    "E": "thistle",
}


def _line(section: int, major, minor, *parts, detail=0) -> list[Column]:
    as_long = lambda c: (F.lit(c) if isinstance(c, int) else c).cast("long")
    return [
        F.col("graph_id"),
        F.lit(section).alias("section"),
        as_long(major).alias("major"),
        as_long(minor).alias("minor"),
        as_long(detail).alias("detail"),
        F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("line"),
    ]


def _ranked(edges: DataFrame, ranks: DataFrame, end: str, name: str) -> DataFrame:
    at = ranks.select("graph_id", F.col("node_id").alias(end), F.col("rank").alias(name))
    return edges.join(at, ["graph_id", end])


def consensus_text(path: DataFrame, nodes: DataFrame, text: str = "symbol") -> DataFrame:
    """graph_id, consensus: the texts along a consensus path."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", text)))
    return (
        path.join(nodes.select("graph_id", "node_id", text), ["graph_id", "node_id"])
        .groupBy("graph_id")
        .agg(F.array_join(F.transform(ordered, lambda e: e[text]), "").alias("consensus"))
    )


def read_paths(paths: DataFrame, ranks: DataFrame) -> DataFrame:
    """graph_id, seq_rank, segments: node ids of each sequence in rank order."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "node_id")))
    return (
        paths.select("graph_id", "seq_rank", "node_id")
        .join(ranks, ["graph_id", "node_id"])
        .groupBy("graph_id", "seq_rank")
        .agg(ordered["node_id"].alias("segments"))
    )


def gfa_lines(
    segments: DataFrame, edges: DataFrame, paths: DataFrame, ranks: DataFrame,
    consensus: DataFrame | None = None,
) -> DataFrame:
    """GFA 1: H, then S with its incoming L lines in rank order, then P lines.

    segments has graph_id, node_id, sequence; consensus has graph_id, pos, node_id.
    """
    views = {"nodes": segments, "edges": edges, "paths": paths, "ranks": ranks}
    graphs = whole.shared(**views) if consensus is None else whole.shared(**views, consensus=consensus)
    if graphs is not None:
        return _whole_lines(graphs, consensus is not None)
    ranks = materialise_graph(ranks, "ranks")  # a walk over whole graphs, made once for all lines
    reads = materialise_graph(read_paths(paths, ranks), "reads")
    sizes = (
        segments.select("graph_id", F.lit(1).alias("s"), F.lit(0).alias("l"), F.lit(0).alias("p"))
        .unionByName(edges.select("graph_id", F.lit(0).alias("s"), F.lit(1).alias("l"), F.lit(0).alias("p")))
        .unionByName(reads.select("graph_id", F.lit(0).alias("s"), F.lit(0).alias("l"), F.lit(1).alias("p")))
        .groupBy("graph_id").agg(F.sum("s").alias("s"), F.sum("l").alias("l"), F.sum("p").alias("p"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "node_id")))["node_id"].alias("segments")
    heaviest = None if consensus is None else consensus.groupBy("graph_id").agg(ordered)
    placed = segments.join(ranks, ["graph_id", "node_id"])
    return _gfa(sizes, placed, _ranked(edges, ranks, "dst", "rank"), reads, heaviest)


def _plus(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: F.concat(i.cast("string"), F.lit("+"))), ",")


def _head(extra: int) -> list[Column]:
    return _line(0, 0, 0, "H\tVN:Z:1.0\tNS:i:", F.col("s"), "\tNL:i:", F.col("l"), "\tNP:i:", F.col("p") + extra)


_SEGMENT = lambda: _line(1, F.col("rank"), -1, "S\t", F.col("node_id"), "\t", F.col("sequence"))
_LINK = lambda: _line(1, F.col("rank"), F.col("ord"), "L\t", F.col("src"), "\t+\t", F.col("dst"), "\t+\t0M")
_READ = lambda: _line(2, F.col("seq_rank"), 0, "P\t", F.col("seq_rank"), "\t", _plus(F.col("segments")), "\t*")
_HEAVIEST = lambda: _line(3, 0, 0, "P\tConsensus_sequence\t", _plus(F.col("segments")), "\t*")


def _gfa(sizes: DataFrame, segments: DataFrame, edges: DataFrame, reads: DataFrame, consensus: DataFrame | None) -> DataFrame:
    """Lines of counts, segments with their rank, edges with that of their end, and the nodes of paths."""
    lines = sizes.select(*_head(0 if consensus is None else 1))
    for rows, drawn in ((segments, _SEGMENT), (edges, _LINK), (reads, _READ), (consensus, _HEAVIEST)):
        if rows is not None:
            lines = lines.unionByName(rows.select(*drawn()))
    return lines


def _whole_lines(graphs: whole.Graphs, with_consensus: bool) -> DataFrame:
    """``gfa_lines`` of graphs that are a row each; what the lines are made of comes from one walk over each."""
    longs = ("s", "l", "p", "rank", "node_id", "src", "dst", "ord", "seq_rank")

    def pieces(g: Whole) -> list:
        src, dst, _, first = g.edges
        rank, (own, _, node, _) = g.rank_of(g.made["order"]), g.places
        ranks, sizes = g.runs_of_ranks()
        nodes = node[np.lexsort((rank[node], own))]
        paths = [ranks, sizes, nodes]
        if with_consensus:
            on = np.asarray(g.made["consensus"], np.int64)
            paths = [np.append(ranks, whole.NO_RANK), np.append(sizes, len(on)), np.concatenate([nodes, on])]
        links, reads, more = len(src), len(ranks), len(paths[0]) - len(ranks)
        kind = np.repeat(np.arange(5), [1, g.size, links, reads, more])
        total = len(kind)
        starts = np.cumsum([0, 1, g.size, links, reads, more])
        made = {c: np.full(total, whole.NO_RANK) for c in longs}
        for part, columns in (
            (0, {"s": g.size, "l": links, "p": reads}), (1, {"rank": rank, "node_id": np.arange(g.size)}),
            (2, {"rank": rank[dst], "src": src, "dst": dst, "ord": first}), (3, {"seq_rank": ranks}),
        ):
            for c, values in columns.items():
                made[c][starts[part] : starts[part + 1]] = values
        blank = total - 1 - g.size
        letters = whole.letters(g)
        none = pa.nulls(1, letters.type), pa.nulls(blank, letters.type)
        widths = np.concatenate([np.zeros(starts[3], np.int64), paths[1]])
        offsets = np.concatenate([[0], np.cumsum(widths)]).astype(np.int32)
        segments = pa.ListArray.from_arrays(pa.array(offsets), pa.array(paths[2].astype(np.int64)))
        return [kind, *(whole.ranked(made[c]) for c in longs), pa.concat_arrays([none[0], letters, none[1]]), segments]

    fields = [T.StructField("kind", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in longs)]
    found = graphs.rows([*fields, T.StructField("sequence", T.StringType()), T.StructField("segments", whole.LONGS)], pieces)
    drawn = [_head(int(with_consensus)), _SEGMENT(), _LINK(), _READ(), _HEAVIEST()]
    column = lambda at, name: F.when(F.col("kind") == at, drawn[at][[*KEYS, "line"].index(name)])
    return found.select("graph_id", *[F.coalesce(*[column(at, name) for at in range(5)]).alias(name) for name in [*KEYS[1:], "line"]])


def dot_lines(nodes: DataFrame, edge_rows: DataFrame, ranks: DataFrame, ids: bool = True) -> DataFrame:
    """DOT: coloured nodes in rank order, edges labelled with their number of sequences.

    Aligned nodes share a rank and are tied by one dashed line per set. ``ids`` adds the
    node id to the label.
    """
    label = (
        F.concat(F.col("symbol"), F.lit(" ("), F.col("node_id").cast("string"), F.lit(")\\nr: "), F.col("rank").cast("string"))
        if ids
        else F.concat(F.col("symbol"), F.lit("\\n"), F.col("rank").cast("string"))
    )
    quoted = F.concat(F.lit('"'), label, F.lit('"')).alias("label")
    drawn = nodes.join(ranks, ["graph_id", "node_id"]).select("graph_id", "node_id", "symbol", "aligned", "rank", quoted)
    drawn = materialise_graph(drawn, "drawn")
    name = lambda end, out: drawn.select(
        "graph_id", F.col("node_id").alias(end), F.col("label").alias(out), F.col("rank").alias(f"{out}_rank")
    )
    counts = drawn.groupBy("graph_id").agg(F.count("*").alias("n"))
    head = [
        "// partial-order graph", None, "digraph po_graph {", '\tgraph [rankdir="LR"];',
        "\tnode [width=1.2, style=filled, fixedsize=true, shape=circle];",
    ]
    opening = F.array(*[
        F.concat(F.lit("// "), F.col("n").cast("string"), F.lit(" nodes")) if text is None else F.lit(text)
        for text in head
    ])
    lines = counts.select("graph_id", F.posexplode(opening).alias("at", "text")).select(
        *_line(0, F.col("at"), 0, F.col("text")))
    colour = F.lit("gray")
    for base, shade in COLOURS.items():
        colour = F.when(F.col("symbol") == base, shade).otherwise(colour)
    lines = lines.unionByName(
        drawn.select(*_line(1, F.col("rank"), 0, F.col("label"), " [color=", colour, ", fontsize=22]"))
    )
    weight = edge_rows.groupBy("graph_id", "src", "dst").agg(
        F.count("*").alias("n"), F.min("ord").alias("ord"))
    lines = lines.unionByName(
        weight.join(name("src", "a"), ["graph_id", "src"]).join(name("dst", "b"), ["graph_id", "dst"]).select(
            *_line(2, F.col("a_rank"), F.col("ord"), "\t", F.col("a"), " -> ", F.col("b"), ' [label="', F.col("n"),
                   '", penwidth=', F.col("n") + 1, "]"))
    )
    tied = (
        drawn.select("graph_id", "node_id", "label", "rank", F.posexplode("aligned").alias("at", "peer"))
        .join(name("peer", "p"), ["graph_id", "peer"])
        .groupBy("graph_id", "node_id", "label", "rank")
        .agg(
            F.array_sort(F.collect_list(F.struct("at", "p")))["p"].alias("peers"),
            F.min("p_rank").alias("peer_rank"),
        )
    )
    last = (1 << 62) - 1  # after all edges of the same rank
    lines = lines.unionByName(
        tied.select(*_line(2, F.col("rank"), last, "\t{rank=same; ", F.col("label"), " ", F.array_join("peers", " "), " };"))
    )
    lines = lines.unionByName(
        tied.filter("rank < peer_rank").select(
            *_line(2, F.col("rank"), last + 1, "\t{ edge [style=dashed, arrowhead=none]; ", F.col("label"), " -> ",
                   F.array_join("peers", " -> "), " }"))
    )
    return lines.unionByName(counts.select(*_line(3, 0, 0, "}")))


def dump_lines(
    nodes: DataFrame, edge_rows: DataFrame, ranks: DataFrame, starts: DataFrame
) -> DataFrame:
    """Plain listing: counts, nodes with their edges and labels, and the rank table."""
    drawn = nodes.join(ranks, ["graph_id", "node_id"]).select("graph_id", "node_id", "symbol", "rank")
    drawn = materialise_graph(drawn, "drawn")
    end = lambda side: drawn.select(
        "graph_id", F.col("node_id").alias(side),
        F.concat(F.col("rank").cast("string"), F.lit(" ("), F.col("symbol"), F.lit(")")).alias(f"{side}_text"),
        F.col("rank").alias(f"{side}_rank"),
    )
    sequences = starts.groupBy("graph_id").agg(F.count("*").alias("q"))
    totals = drawn.groupBy("graph_id").agg(F.count("*").alias("n")).join(sequences, "graph_id")
    header = F.array(
        F.concat(F.lit("num_sequences: "), F.col("q").cast("string")),
        F.concat(F.lit("num_nodes: "), F.col("n").cast("string")),
    )
    lines = totals.select("graph_id", F.posexplode(header).alias("at", "text")).select(
        *_line(0, F.col("at"), 0, F.col("text")))
    lines = lines.unionByName(
        drawn.select(*_line(1, F.col("rank"), -1, "\t", F.col("node_id"), ": ", F.col("symbol"))))
    merged = merge_edges(edge_rows)
    edges = merged.join(end("src"), ["graph_id", "src"]).join(end("dst"), ["graph_id", "dst"])
    weight = [" - W: ", F.col("weight")]
    far = 1 << 40  # outgoing edges come after incoming ones
    incoming, outgoing = (F.col("dst_rank"), F.col("ord")), (F.col("src_rank"), F.col("ord") + far)
    lines = lines.unionByName(
        edges.select(*_line(1, *incoming, "\t\t", F.col("dst_text"), " <--- ", F.col("src_text"), *weight)))
    lines = lines.unionByName(
        edges.select(*_line(1, *outgoing, "\t\t", F.col("src_text"), " ---> ", F.col("dst_text"), *weight)))
    # labels are rows of their own: an edge may carry any number of them
    labelled = edges.drop("weight").join(
        edge_rows.select("graph_id", "src", "dst", "label"), ["graph_id", "src", "dst"])
    for side in (incoming, outgoing):
        lines = lines.unionByName(labelled.select(
            *_line(1, *side, "\t\t\tsequence_label: ", F.col("label"), detail=F.col("label") + 1)))
    lines = lines.unionByName(totals.select(*_line(2, -1, 0, "Rank\tNodeId")))
    return lines.unionByName(drawn.select(*_line(
        2, F.col("rank"), 0, "\t", F.col("rank"), "\t", F.col("node_id"), " (", F.col("symbol"), ")")))


def write_lines(lines: DataFrame, path: str) -> None:
    """Write lines as text, globally sorted: part files in name order are the document."""
    lines.orderBy(*KEYS).select("line").write.text(path)
