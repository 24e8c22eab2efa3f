"""Small graphs with known results, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Segment texts of the three example graphs.
EXAMPLES = {
    1: ["ACT", "ACCTG", "GT", "ACT"],
    2: ["AAA", "TTT", "GGG", "AAA"],
    3: ["A", "G"],
}
# Sequences of the partial-order example and their alignments (node, position).
PO_SEQUENCES = ["CAAATAAGT", "CCAATAAT", "CCTATC"]
PO_PAIRS = [
    None,
    [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, None), (8, 7)],
    [(0, 0), (9, 1), (2, None), (3, None), (4, 2), (5, 3), (6, 4), (8, 5)],
]


def example_graph(spark: SparkSession, number: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, edge rows, paths): 1 and 2 are bubbles, 3 is a chain; segment ids from 1."""
    texts = EXAMPLES[number]
    routes = [[1, 2, 4], [1, 3, 4]] if len(texts) == 4 else [[1, 2]]
    segments = spark.createDataFrame(
        [(number, i, text) for i, text in enumerate(texts, 1)],
        "graph_id long, segment_id long, sequence string",
    )
    steps = [(a, b, label) for label, route in enumerate(routes) for a, b in zip(route, route[1:])]
    edges = spark.createDataFrame(
        [(number, a, b, label, 2, at) for at, (a, b, label) in enumerate(steps)],
        "graph_id long, src long, dst long, label int, weight long, ord int",
    )
    paths = spark.createDataFrame(
        [(number, label, at, v) for label, route in enumerate(routes) for at, v in enumerate(route)],
        "graph_id long, seq_rank int, pos int, node_id long",
    )
    return segments, edges, paths


def po_sequences(spark: SparkSession) -> DataFrame:
    rows = list(zip([4] * 3, range(3), PO_SEQUENCES, PO_PAIRS))
    return spark.createDataFrame(
        rows, "graph_id long, seq_rank int, seq string, pairs array<struct<node:int,pos:int>>"
    )
