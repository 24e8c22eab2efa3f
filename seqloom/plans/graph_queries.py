"""Registered queries: partial-order graphs, orders, consensus, MSA, exports, alignment."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqloom.functions import cigar
from seqloom.functions.text import distance
from seqloom.operators import checks, export, graph_align, msa, ranking, segments as seg, whole
from seqloom.operators.aligned_growth import aligned_growth
from seqloom.operators.cycles import cycles
from seqloom.operators.numbering import number_within
from seqloom.operators.pograph import PoGraph, grown_graph, star_graph
from seqloom.plans.oracle import BUNDLE, GRAPH, GROUPED, LADDER_SCORE, LADDERS, NEWEST, READS, STAR, STAR_DISTANCE
from seqloom.plans.registry import query
from seqloom.sources.graphs import (
    ladder_graph, ladders, positional_graph, star_aligned_graph, star_sequences, text_sequences, written_graph,
)
from seqloom.session import materialise_graph, shared_folder
from seqloom.sources.graph_files import GraphFiles, in_line_order, read_lines
from seqloom.sources.reads import reads, written_bundles
from seqloom.sources.tables import table


def long_ids(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if c in columns else c for c in df.columns])


def graph_of(spark: SparkSession, folder: str) -> PoGraph:
    return written_graph(spark, folder)


def ranks_of(spark: SparkSession, folder: str, order: str = "depth") -> DataFrame:
    graph = graph_of(spark, folder)
    return ranking.ranks(graph.nodes, graph.edges(), order)


@query(f"WITH {GRAPH} SELECT graph_id, node_id, symbol FROM nodes")
def po_nodes(spark, folder):
    return positional_graph(spark, folder).nodes.select("graph_id", "node_id", "symbol")


@query(f"WITH {GRAPH} SELECT graph_id, src, dst, weight, ord FROM edges")
def po_edges(spark, folder):
    return long_ids(positional_graph(spark, folder).edges(), "ord")


@query(f"""WITH {GRAPH} SELECT graph_id, src, dst, string_agg(label::VARCHAR, ',' ORDER BY label) AS labels
FROM steps GROUP BY 1, 2, 3""")
def po_labels(spark, folder):
    arrays = seg.label_arrays(graph_of(spark, folder).edge_rows())
    return arrays.select(
        "graph_id", "src", "dst", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels")
    )


@query(f"""WITH {GRAPH} SELECT a.graph_id, a.node_id, count(b.node_id) AS peers,
coalesce(string_agg(b.node_id::VARCHAR, ',' ORDER BY b.node_id), '') AS named
FROM nodes a LEFT JOIN nodes b ON a.graph_id = b.graph_id AND a.pos = b.pos AND a.symbol <> b.symbol
GROUP BY 1, 2""")
def po_aligned_nodes(spark, folder):
    return graph_of(spark, folder).nodes.select(
        "graph_id", "node_id", F.size("aligned").cast("long").alias("peers"),
        F.array_join(F.array_sort("aligned").cast("array<string>"), ",").alias("named"),
    )


@query(f"WITH {GRAPH} SELECT graph_id, seq_rank, node_id FROM paths WHERE pos = 0")
def po_starts(spark, folder):
    return graph_of(spark, folder).starts()


@query(f"WITH {GRAPH} SELECT DISTINCT graph_id, node_id FROM paths WHERE pos = 0")
def po_distinct_starts(spark, folder):
    return graph_of(spark, folder).starts().select("graph_id", "node_id").distinct()


@query(f"""WITH {GRAPH} SELECT graph_id, src AS node_id, dst AS next_id FROM steps WHERE label = 1""")
def po_successors(spark, folder):
    return seg.successors(graph_of(spark, folder).edge_rows(), 1)


@query(f"""WITH {GRAPH} SELECT graph_id, node_id, symbol FROM nodes n
WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = n.graph_id AND e.dst = n.node_id)""")
def po_sources(spark, folder):
    graph = graph_of(spark, folder)
    return seg.sources(graph.nodes, graph.edges()).select("graph_id", "node_id", "symbol")


@query(f"""WITH {GRAPH} SELECT graph_id, node_id, symbol FROM nodes n
WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = n.graph_id AND e.src = n.node_id)""")
def po_sinks(spark, folder):
    graph = graph_of(spark, folder)
    return seg.sinks(graph.nodes, graph.edges()).select("graph_id", "node_id", "symbol")


@query(f"""WITH {GRAPH}, ends AS (
SELECT graph_id, dst AS node_id, 1 AS i, 0 AS o FROM edges UNION ALL
SELECT graph_id, src, 0, 1 FROM edges UNION ALL
SELECT graph_id, node_id, 0, 0 FROM nodes)
SELECT graph_id, node_id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM ends GROUP BY 1, 2""")
def in_degree(spark, folder):
    graph = graph_of(spark, folder)
    return seg.degrees(graph.nodes, graph.edges())


@query(f"WITH {GRAPH} SELECT graph_id, count(*) AS links FROM edges GROUP BY 1")
def link_count(spark, folder):
    return seg.link_counts(graph_of(spark, folder).edges())


@query(f"WITH {GRAPH} SELECT graph_id, rank AS rank, node_id FROM nodes")
def topological_rank(spark, folder):
    return long_ids(ranks_of(spark, folder), "rank")


@query(f"{NEWEST} SELECT graph_id, rank, stack[-1] AS node_id FROM walk WHERE len(stack) > 0")
def topological_rank_newest_first(spark, folder):
    return long_ids(ranks_of(spark, folder, "newest"), "rank")


@query(f"{GROUPED} SELECT graph_id, rank, stack[-1] AS node_id FROM walk WHERE len(stack) > 0")
def topological_rank_grouped(spark, folder):
    return long_ids(ranks_of(spark, folder, "grouped"), "rank")


# graphs of whole conversations: a node per place and symbol, as many as the texts need
TALKS = """
turns AS (SELECT conv_id AS graph_id, turn, coalesce(text, '') AS text, turn - min(turn) OVER (PARTITION BY conv_id) AS seq_rank
  FROM conversations WHERE text <> ''),
sized AS (SELECT *, first_value(len(text)) OVER (PARTITION BY graph_id ORDER BY turn) AS size FROM turns),
bases AS (SELECT graph_id, seq_rank, size, unnest(range(len(text))) AS pos, unnest(string_split(text, '')) AS symbol FROM sized),
placed AS (SELECT *, CASE WHEN pos < size THEN pos ELSE -1 - seq_rank * 1000000 - pos END AS place FROM bases),
steps AS (SELECT p.graph_id, p.seq_rank, p.place AS a, p.symbol AS x, q.place AS b, q.symbol AS y
  FROM placed p JOIN placed q ON p.graph_id = q.graph_id AND p.seq_rank = q.seq_rank AND q.pos = p.pos + 1)"""


#: Characters of the largest conversation up to which every one is made in a task; beyond, all are made with joins.
WHOLE_SYMBOLS = 4_000_000


def talk_graph(spark: SparkSession, folder: str) -> PoGraph:
    turns = table(spark, folder, "conversations", "conv_id", "turn", "text").filter("text <> ''")
    dealt = turns.repartition(4 * spark.sparkContext.defaultParallelism, "conv_id")
    sequences = text_sequences(dealt, "conv_id", "turn")
    largest = turns.groupBy("conv_id").agg(F.sum(F.length("text")).alias("symbols")).agg(F.max("symbols")).first()[0] or 0
    if largest <= WHOLE_SYMBOLS:
        return star_graph(sequences.drop("pairs"))
    # few bytes of text make very many rows, so they are dealt out before texts are taken apart
    few = sequences.drop("runs").repartition(4 * spark.sparkContext.defaultParallelism)
    return star_graph(materialise_graph(few, "talks"))


@query(f"""WITH {TALKS}, nodes AS (SELECT DISTINCT graph_id, place, symbol FROM placed),
edges AS (SELECT graph_id, a, x, b, y, 2 * count(*) AS weight FROM steps GROUP BY ALL)
SELECT n.graph_id, n.nodes, coalesce(e.edges, 0) AS edges, coalesce(e.weight, 0)::BIGINT AS weight
FROM (SELECT graph_id, count(*) AS nodes FROM nodes GROUP BY 1) n
LEFT JOIN (SELECT graph_id, count(*) AS edges, sum(weight) AS weight FROM edges GROUP BY 1) e USING (graph_id)""")
def conversation_graph_sizes(spark, folder):
    graph = talk_graph(spark, folder).written()
    edges = graph.edges().groupBy("graph_id").agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))
    nodes = graph.nodes.groupBy("graph_id").agg(F.count("*").alias("nodes"))
    return nodes.join(edges, "graph_id", "left").select(
        "graph_id", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("weight", F.lit(0)).alias("weight")
    )


@query(f"WITH {TALKS} SELECT coalesce(2 * count(*), 0)::BIGINT AS weight, 0::BIGINT AS violations FROM steps")
def conversation_rank_is_valid(spark, folder):
    graph = talk_graph(spark, folder).written()
    edges = graph.edges()
    return evidence(edges, seg.rank_violations(edges, ranking.ranks(graph.nodes, edges)))


def written_talks(spark: SparkSession, folder: str) -> PoGraph:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _talks:
        _talks[key] = talk_graph(spark, folder).written()
    return _talks[key]


_talks: dict[tuple[str, str], PoGraph] = {}


@query(f"""WITH {TALKS}, nodes AS (SELECT DISTINCT graph_id, place, symbol FROM placed),
edges AS (SELECT DISTINCT graph_id, a, x, b, y FROM steps)
SELECT graph_id, 0 AS section, count(*) AS lines FROM (SELECT DISTINCT graph_id FROM nodes) GROUP BY 1
UNION ALL SELECT graph_id, 1, count(*) FROM (SELECT graph_id FROM nodes UNION ALL SELECT graph_id FROM edges) GROUP BY 1
UNION ALL SELECT graph_id, 2, count(*) FROM turns GROUP BY 1 UNION ALL SELECT DISTINCT graph_id, 3, 1 FROM nodes""")
def conversation_gfa_lines(spark, folder):
    """GFA of whole conversations with their consensus: lines of each section."""
    graph = written_talks(spark, folder)
    edges = whole.kept(graph.edges(), "edges")
    ranks, path = ranking.ranks_and_consensus(graph.nodes, edges)
    nodes = whole.renamed(graph.nodes, "symbol", "sequence")
    lines = export.gfa_lines(nodes, edges, graph.paths, ranks, path)
    return lines.groupBy("graph_id", "section").agg(F.count("*").alias("lines"))


@query(f"WITH {TALKS} SELECT graph_id, seq_rank::INT AS seq_rank, replace(text, '-', '') AS seq, 1::BIGINT AS widths FROM turns")
def conversation_msa_rows(spark, folder):
    """Rows of the alignment of whole conversations without their gaps; all rows of one have one width."""
    graph = written_talks(spark, folder)
    ranks = ranking.ranks(graph.nodes, graph.edges())
    made = materialise_graph(msa.rows(graph.paths, graph.nodes, msa.columns(graph.nodes, ranks)), "rows")
    widths = made.groupBy("graph_id").agg(F.countDistinct(F.length("row")).alias("widths"))
    seq = F.replace("row", F.lit("-"), F.lit("")).alias("seq")
    return made.select("graph_id", "seq_rank", seq).join(widths, "graph_id")


@query(f"WITH {TALKS} SELECT graph_id, 1::BIGINT AS starts, 1::BIGINT AS ends, 0::BIGINT AS jumps FROM turns GROUP BY 1")
def conversation_consensus_is_a_path(spark, folder):
    """Consensus of whole conversations: it starts at a node without a way in, ends at one without a way out, and follows edges."""
    graph = written_talks(spark, folder)
    edges = whole.kept(graph.edges(), "edges")
    path = whole.kept(ranking.consensus(graph.nodes, edges), "consensus")
    jumps = seg.jumps(path, edges).groupBy("graph_id").agg(F.count("*").alias("jumps"))
    end = lambda of, name: seg.among(path, of(graph.nodes, edges)).groupBy("graph_id").agg(F.count("*").alias(name))
    return end(seg.sources, "starts").join(end(seg.sinks, "ends"), "graph_id").join(jumps, "graph_id", "left").select(
        "graph_id", "starts", "ends", F.coalesce("jumps", F.lit(0)).alias("jumps")
    )


def evidence(edges: DataFrame, broken: DataFrame) -> DataFrame:
    """Weight and number of the edges that were looked at, and how many of them fail."""
    looked = edges.select("weight", F.lit(0).alias("fails")).unionByName(broken.select(F.lit(0).cast("long").alias("weight"), F.lit(1).alias("fails")))
    return looked.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"), F.coalesce(F.sum("fails"), F.lit(0)).alias("violations"))


CHECKED = f"WITH {GRAPH} SELECT coalesce(sum(weight), 0)::BIGINT AS weight, 0::BIGINT AS violations FROM edges"


def violations(spark: SparkSession, folder: str, order: str) -> DataFrame:
    edges = graph_of(spark, folder).edges()
    broken = seg.rank_violations(edges, ranks_of(spark, folder, order))
    return evidence(edges, broken)


@query(CHECKED)
def rank_is_valid(spark, folder):
    return violations(spark, folder, "depth")


@query(CHECKED)
def rank_is_valid_newest_first(spark, folder):
    return violations(spark, folder, "newest")


@query(CHECKED)
def rank_is_valid_grouped(spark, folder):
    return violations(spark, folder, "grouped")


@query(f"""WITH {GRAPH} SELECT graph_id, string_agg(symbol, '' ORDER BY rank) AS spelling
FROM nodes GROUP BY 1""")
def graph_spelling(spark, folder):
    return seg.spelling(graph_of(spark, folder).nodes, ranks_of(spark, folder))


# longest path per node: in the position-wise graph every step advances one position
@query(f"""WITH {LADDERS} SELECT graph_id, s AS node_id, (s - 1) % 3 AS level
FROM rungs, (SELECT unnest(range(1, 7)) AS s)""")
def topological_levels(spark, folder):
    segments, edges, _ = ladder_graph(ladders(written_bundles(spark, folder)))
    nodes = segments.withColumnRenamed("segment_id", "node_id")
    return long_ids(seg.levels(nodes, edges), "level")


@query(f"""WITH {LADDERS} SELECT graph_id, s AS node_id,
row_number() OVER (PARTITION BY graph_id ORDER BY (s - 1) % 3, s) - 1 AS rank
FROM rungs, (SELECT unnest(range(1, 7)) AS s)""")
def topological_level_order(spark, folder):
    segments, edges, _ = ladder_graph(ladders(written_bundles(spark, folder)))
    nodes = segments.withColumnRenamed("segment_id", "node_id")
    return seg.level_order(seg.levels(nodes, edges)).select("graph_id", "node_id", "rank")


# weight first, then the predecessor's score, then the later edge, position by position
HEAVIEST = f"""WITH RECURSIVE {GRAPH},
deep AS (SELECT graph_id, node_id, pos FROM nodes),
best AS (
  SELECT graph_id, node_id, pos, -1::BIGINT AS score FROM deep WHERE pos = 0
  UNION ALL
  SELECT graph_id, node_id, pos, score FROM (
    SELECT e.graph_id, e.dst AS node_id, b.pos + 1 AS pos, e.weight + b.score AS score,
           row_number() OVER (PARTITION BY e.graph_id, e.dst
                              ORDER BY e.weight DESC, b.score DESC, e.ord DESC) AS choice
    FROM best b JOIN edges e ON e.graph_id = b.graph_id AND e.src = b.node_id)
  WHERE choice = 1)"""


@query(f"{HEAVIEST} SELECT graph_id, node_id, score FROM best")
def heaviest_bundle_scores(spark, folder):
    graph = graph_of(spark, folder)
    return ranking.consensus_scores(graph.nodes, graph.edges())


@query(f"{BUNDLE} SELECT graph_id, step AS pos, node_id FROM bundle")
def heaviest_bundle(spark, folder):
    graph = graph_of(spark, folder)
    return long_ids(ranking.consensus(graph.nodes, graph.edges()), "pos")


@query(f"{BUNDLE} SELECT graph_id, string_agg(symbol, '' ORDER BY step) AS consensus FROM bundle GROUP BY 1")
def consensus_text(spark, folder):
    graph = graph_of(spark, folder)
    path = ranking.consensus(graph.nodes, graph.edges())
    return export.consensus_text(path, graph.nodes)


@query(f"WITH {GRAPH} SELECT graph_id, node_id, pos AS column FROM nodes")
def msa_columns(spark, folder):
    graph = graph_of(spark, folder)
    return msa.columns(graph.nodes, ranks_of(spark, folder))


@query(f"WITH {GRAPH} SELECT graph_id, node_id, pos AS column FROM nodes")
def msa_columns_released(spark, folder):
    graph = graph_of(spark, folder)
    return ranking.released_columns(graph.nodes, graph.edges())


@query(f"""WITH {READS}, wide AS (SELECT graph_id, max(len(seq)) AS width FROM reads GROUP BY 1)
SELECT graph_id, seq_rank, rpad(seq, width::INT, '-') AS row FROM reads JOIN wide USING (graph_id)""")
def msa_rows(spark, folder):
    graph = graph_of(spark, folder)
    return msa.rows(graph.paths, graph.nodes, msa.columns(graph.nodes, ranks_of(spark, folder)))


@query(BUNDLE + """,
wide AS (SELECT graph_id, max(pos) + 1 AS width FROM nodes GROUP BY 1),
cells AS (SELECT graph_id, unnest(range(width)) AS pos FROM wide),
heavy AS (SELECT b.graph_id, n.pos, n.symbol FROM bundle b JOIN nodes n USING (graph_id, node_id))
SELECT graph_id, seq_rank, rpad(seq, width::INT, '-') AS row FROM reads JOIN wide USING (graph_id)
UNION ALL SELECT graph_id, NULL, string_agg(coalesce(symbol, '-'), '' ORDER BY pos)
FROM cells LEFT JOIN heavy USING (graph_id, pos) GROUP BY graph_id""")
def msa_rows_with_consensus(spark, folder):
    """One row per sequence, and the consensus row, whose seq_rank is null."""
    graph = graph_of(spark, folder)
    path = ranking.consensus(graph.nodes, graph.edges()).select(
        "graph_id", F.lit(None).cast("int").alias("seq_rank"), "node_id"
    )
    paths = graph.paths.select("graph_id", "seq_rank", "node_id").unionByName(path)
    return msa.rows(paths, graph.nodes, msa.columns(graph.nodes, ranks_of(spark, folder)))


def star_msa(spark: SparkSession, folder: str) -> DataFrame:
    """MSA with consensus row of the graphs aligned by edit distance."""
    graph = written_graph(spark, folder, "star")
    edges = graph.edges()
    ranks, path = ranking.ranks_and_consensus(graph.nodes, edges)
    placed = msa.columns(graph.nodes, ranks)
    path = path.select(
        "graph_id", F.lit(None).cast("int").alias("seq_rank"), "node_id"
    )
    return msa.rows(graph.paths.select("graph_id", "seq_rank", "node_id").unionByName(path), graph.nodes, placed)


@query()
def star_msa_rows(spark, folder):
    return star_msa(spark, folder)


@query(f"WITH {READS} SELECT graph_id, seq_rank, seq FROM reads")
def star_msa_without_gaps(spark, folder):
    return star_msa(spark, folder).filter("seq_rank is not null").select(
        "graph_id", "seq_rank", F.replace("row", F.lit("-"), F.lit("")).alias("seq")
    )


@query(f"{STAR} SELECT graph_id, node_id, symbol FROM nodes")
def star_po_nodes(spark, folder):
    return star_aligned_graph(spark, folder).nodes.select("graph_id", "node_id", "symbol")


@query(f"{STAR} SELECT graph_id, src, dst, weight, ord FROM edges")
def star_po_edges(spark, folder):
    return long_ids(star_aligned_graph(spark, folder).edges(), "ord")


# the same alignments, but grown one sequence at a time
@query(f"{STAR} SELECT graph_id, src, dst, weight, ord FROM edges")
def round_grown_po_edges(spark, folder):
    graph = grown_graph(star_sequences(written_bundles(spark, folder)))
    return long_ids(graph.edges(), "ord")


# every aligned base either reuses a node or makes one; the weights count every step twice
@query(f"""WITH {READS} SELECT graph_id, sum(2 * (len(seq) - 1))::BIGINT AS weight, count(*) AS sequences
FROM reads GROUP BY 1""")
def star_graph_weight(spark, folder):
    graph = star_aligned_graph(spark, folder)
    weights = graph.edges().groupBy("graph_id").agg(F.sum("weight").alias("weight"))
    counts = graph.starts().groupBy("graph_id").agg(F.count("*").alias("sequences"))
    return counts.join(weights, "graph_id", "left").select(
        "graph_id", F.coalesce("weight", F.lit(0)).alias("weight"), "sequences"
    )


# the weights of a star graph count every step of every read twice
@query(f"""WITH {READS} SELECT sum(2 * (len(seq) - 1))::BIGINT AS weight, 0::BIGINT AS violations FROM reads""")
def star_rank_is_valid(spark, folder):
    graph = written_graph(spark, folder, "star")
    order = ranking.ranks(graph.nodes, graph.edges())
    return evidence(graph.edges(), seg.rank_violations(graph.edges(), order))


@query(f"""WITH {GRAPH} SELECT graph_id, seq_rank, string_agg(node_id::VARCHAR, ',' ORDER BY pos) AS segments
FROM paths GROUP BY 1, 2""")
def read_paths(spark, folder):
    graph = graph_of(spark, folder)
    routes = export.read_paths(graph.paths, ranks_of(spark, folder))
    return routes.select(
        "graph_id", "seq_rank", F.array_join(F.col("segments").cast("array<string>"), ",").alias("segments")
    )


def gfa_sql(start: str, consensus: int) -> str:
    return f"""{start},
sizes AS (SELECT graph_id, (SELECT count(*) FROM nodes n WHERE n.graph_id = g.graph_id) AS s,
  (SELECT count(*) FROM edges e WHERE e.graph_id = g.graph_id) AS l,
  (SELECT count(*) FROM reads r WHERE r.graph_id = g.graph_id) AS p
  FROM (SELECT DISTINCT graph_id FROM nodes) g)
SELECT graph_id, 0 AS section, 0 AS major, 0 AS minor, 0 AS detail, 'H' || chr(9) || 'VN:Z:1.0' || chr(9) || 'NS:i:' || s
  || chr(9) || 'NL:i:' || l || chr(9) || 'NP:i:' || (p + {consensus}) AS line FROM sizes
UNION ALL SELECT graph_id, 1, rank, -1, 0, 'S' || chr(9) || node_id || chr(9) || symbol FROM nodes
UNION ALL SELECT graph_id, 1, dst_rank, ord, 0,
  'L' || chr(9) || src || chr(9) || '+' || chr(9) || dst || chr(9) || '+' || chr(9) || '0M' FROM edges
UNION ALL SELECT graph_id, 2, seq_rank, 0, 0, 'P' || chr(9) || seq_rank || chr(9)
  || string_agg(node_id || '+', ',' ORDER BY pos) || chr(9) || '*' FROM paths GROUP BY graph_id, seq_rank"""


@query(gfa_sql(f"WITH {GRAPH}", 0))
def gfa_lines(spark, folder):
    graph = graph_of(spark, folder)
    nodes = graph.nodes.withColumnRenamed("symbol", "sequence")
    return export.gfa_lines(nodes, graph.edges(), graph.paths, ranks_of(spark, folder))


@query(gfa_sql(BUNDLE, 1) + """
UNION ALL SELECT graph_id, 3, 0, 0, 0, 'P' || chr(9) || 'Consensus_sequence' || chr(9)
  || string_agg(node_id || '+', ',' ORDER BY step) || chr(9) || '*' FROM bundle GROUP BY graph_id""")
def gfa_lines_with_consensus(spark, folder):
    graph = graph_of(spark, folder)
    edges = graph.edges()
    nodes = graph.nodes.withColumnRenamed("symbol", "sequence")
    ranks, path = ranking.ranks_and_consensus(graph.nodes, edges)
    return export.gfa_lines(nodes, edges, graph.paths, ranks, path)


DOT = f"""WITH {GRAPH},
drawn AS (SELECT *, '"' || symbol || ' (' || node_id || ')\\nr: ' || (rank) || '"' AS label,
  count(*) OVER (PARTITION BY graph_id, pos) AS members,
  min(rank) OVER (PARTITION BY graph_id, pos) AS lead_rank FROM nodes),
peers AS (SELECT a.graph_id, a.node_id, a.label, a.rank, a.lead_rank, b.label AS p,
  CASE WHEN a.rank = a.lead_rank THEN b.rank WHEN b.rank < a.rank AND b.rank <> b.lead_rank THEN b.rank
       WHEN b.rank = b.lead_rank THEN a.rank ELSE b.rank END AS place
  FROM drawn a JOIN drawn b ON a.graph_id = b.graph_id AND a.pos = b.pos AND a.node_id <> b.node_id),
counts AS (SELECT graph_id, count(*) AS n FROM nodes GROUP BY 1)
SELECT graph_id, 0 AS section, 0 AS major, 0 AS minor, 0 AS detail, '// partial-order graph' AS line FROM counts
UNION ALL SELECT graph_id, 0, 1, 0, 0, '// ' || n || ' nodes' FROM counts
UNION ALL SELECT graph_id, 0, 2, 0, 0, 'digraph po_graph {{' FROM counts
UNION ALL SELECT graph_id, 0, 3, 0, 0, chr(9) || 'graph [rankdir="LR"];' FROM counts
UNION ALL SELECT graph_id, 0, 4, 0, 0, chr(9) || 'node [width=1.2, style=filled, fixedsize=true, shape=circle];' FROM counts
UNION ALL SELECT graph_id, 1, rank, 0, 0, label || ' [color=' || CASE symbol WHEN 'A' THEN 'lightskyblue'
  WHEN 'C' THEN 'salmon' WHEN 'G' THEN 'lightgoldenrod' WHEN 'T' THEN 'limegreen' WHEN 'S' THEN 'thistle'
  WHEN 'E' THEN 'thistle' ELSE 'gray' END || ', fontsize=22]' FROM drawn
UNION ALL SELECT e.graph_id, 2, a.rank, e.ord, 0, chr(9) || a.label || ' -> ' || b.label || ' [label="' || e.n
  || '", penwidth=' || (e.n + 1) || ']' FROM edges e
  JOIN drawn a ON a.graph_id = e.graph_id AND a.node_id = e.src
  JOIN drawn b ON b.graph_id = e.graph_id AND b.node_id = e.dst
UNION ALL SELECT graph_id, 2, rank, 4611686018427387903, 0, chr(9) || '{{rank=same; ' || label || ' '
  || string_agg(p, ' ' ORDER BY place) || ' }};' FROM peers GROUP BY graph_id, node_id, label, rank
UNION ALL SELECT graph_id, 2, rank, 4611686018427387904, 0, chr(9) || '{{ edge [style=dashed, arrowhead=none]; '
  || label || ' -> ' || string_agg(p, ' -> ' ORDER BY place) || ' }}' FROM peers WHERE rank = lead_rank
  GROUP BY graph_id, node_id, label, rank
UNION ALL SELECT graph_id, 3, 0, 0, 0, '}}' FROM counts"""


@query(DOT)
def dot_lines(spark, folder):
    graph = graph_of(spark, folder)
    return export.dot_lines(graph.nodes, graph.edge_rows(), ranks_of(spark, folder))


@query(DOT.replace("|| ' (' || node_id || ')\\nr: ' || (rank)", "|| '\\n' || (rank)"))
def dot_lines_without_ids(spark, folder):
    graph = graph_of(spark, folder)
    return export.dot_lines(graph.nodes, graph.edge_rows(), ranks_of(spark, folder), ids=False)


@query(f"""WITH {GRAPH},
counts AS (SELECT graph_id, count(*) AS n FROM nodes GROUP BY 1),
seqs AS (SELECT graph_id, count(*) AS q FROM reads GROUP BY 1),
drawn AS (SELECT *, src_rank || ' (' || src_symbol || ')' AS s, dst_rank || ' (' || dst_symbol || ')' AS d FROM edges),
marked AS (SELECT e.*, l.label FROM edges e JOIN steps l USING (graph_id, src, dst))
SELECT graph_id, 0 AS section, 0 AS major, 0 AS minor, 0 AS detail, 'num_sequences: ' || q AS line FROM seqs
UNION ALL SELECT graph_id, 0, 1, 0, 0, 'num_nodes: ' || n FROM counts
UNION ALL SELECT graph_id, 1, rank, -1, 0, chr(9) || node_id || ': ' || symbol FROM nodes
UNION ALL SELECT graph_id, 1, dst_rank, ord, 0, chr(9) || chr(9) || d || ' <--- ' || s || ' - W: ' || weight FROM drawn
UNION ALL SELECT graph_id, 1, src_rank, ord + 1099511627776, 0, chr(9) || chr(9) || s || ' ---> ' || d || ' - W: ' || weight FROM drawn
UNION ALL SELECT graph_id, 1, dst_rank, ord, label + 1, chr(9) || chr(9) || chr(9) || 'sequence_label: ' || label FROM marked
UNION ALL SELECT graph_id, 1, src_rank, ord + 1099511627776, label + 1, chr(9) || chr(9) || chr(9) || 'sequence_label: ' || label FROM marked
UNION ALL SELECT graph_id, 2, -1, 0, 0, 'Rank' || chr(9) || 'NodeId' FROM counts
UNION ALL SELECT graph_id, 2, rank, 0, 0, chr(9) || rank || chr(9) || node_id || ' (' || symbol || ')' FROM nodes""")
def dump_lines(spark, folder):
    graph = graph_of(spark, folder)
    return export.dump_lines(graph.nodes, graph.edge_rows(), ranks_of(spark, folder), graph.starts())


@query(f"""WITH RECURSIVE {GRAPH},
outs AS (SELECT graph_id, src FROM edges GROUP BY 1, 2 HAVING count(*) = 1),
ins AS (SELECT graph_id, dst FROM edges GROUP BY 1, 2 HAVING count(*) = 1),
links AS (SELECT e.graph_id, e.src, e.dst FROM edges e JOIN outs USING (graph_id, src) JOIN ins USING (graph_id, dst)),
walk AS (
  SELECT graph_id, node_id AS unitig_id, node_id, symbol AS sequence, 1::BIGINT AS length FROM nodes n
  WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.graph_id = n.graph_id AND l.dst = n.node_id)
  UNION ALL
  SELECT w.graph_id, w.unitig_id, l.dst, w.sequence || n.symbol, w.length + 1
  FROM walk w JOIN links l ON l.graph_id = w.graph_id AND l.src = w.node_id
              JOIN nodes n ON n.graph_id = l.graph_id AND n.node_id = l.dst)
SELECT graph_id, unitig_id, max(length) AS length, max_by(sequence, length) AS sequence FROM walk GROUP BY 1, 2""")
def unitig_compaction(spark, folder):
    graph = graph_of(spark, folder)
    _, compact = seg.unitigs(graph.nodes, graph.edges())
    return compact


def ladder_alignment(spark: SparkSession, folder: str, method: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    segments, edges, queries = ladder_graph(ladders(written_bundles(spark, folder)))
    return graph_align.align_graphs(queries, segments, edges, method), segments, queries


@query(f"WITH {LADDERS} SELECT graph_id, {LADDER_SCORE} AS score FROM thirds")
def dag_distance_dp(spark, folder):
    return ladder_alignment(spark, folder, "table")[0].select("graph_id", "score")


@query(f"WITH {LADDERS} SELECT graph_id, {LADDER_SCORE} AS score FROM thirds")
def dag_distance_wavefront(spark, folder):
    return ladder_alignment(spark, folder, "wavefront")[0].select("graph_id", "score")


@query(f"WITH {LADDERS} SELECT graph_id, {LADDER_SCORE} AS score FROM thirds")
def dag_distance_by_level(spark, folder):
    segments, edges, queries = ladder_graph(ladders(written_bundles(spark, folder)))
    return graph_align.align_by_level(queries, segments, edges).select("graph_id", "score")


def checked_path(spark: SparkSession, folder: str, method: str) -> DataFrame:
    """Replay each path: its operations against the text its segments spell."""
    found, segments, queries = ladder_alignment(spark, folder, method)
    steps = found.select("graph_id", "score", F.posexplode("path").alias("at", "step"))
    spelled = (
        steps.select("graph_id", "score", "at", F.col("step.segment").alias("segment_id"), "step.ops")
        .join(segments, ["graph_id", "segment_id"])
        .groupBy("graph_id", "score")
        .agg(F.array_sort(F.collect_list(F.struct("at", "ops", "sequence"))).alias("s"))
        .select(
            "graph_id", "score",
            F.array_join("s.ops", "").alias("ops"), F.array_join("s.sequence", "").alias("text"),
        )
        .join(queries, "graph_id")
    )
    return spelled.select(
        "graph_id",
        cigar.edit_score(F.col("ops")).alias("score"),
        cigar.is_valid(F.col("ops"), F.col("pattern"), F.col("text")).alias("valid"),
        distance(F.col("pattern"), F.col("text")).alias("text_distance"),
    )


CHECKED = f"""WITH {LADDERS}, scored AS (SELECT graph_id, {LADDER_SCORE} AS score FROM thirds)
SELECT graph_id, score, true AS valid, score AS text_distance FROM scored"""


@query(CHECKED)
def dag_alignment_segments(spark, folder):
    return checked_path(spark, folder, "table")


@query(CHECKED)
def dag_alignment_segments_wavefront(spark, folder):
    return checked_path(spark, folder, "wavefront")


@query()
def dag_alignment_cigar(spark, folder):
    return ladder_alignment(spark, folder, "table")[0].select("graph_id", "score", "cigar")


@query(f"""WITH {LADDERS} SELECT graph_id, string_agg('S' || chr(9) || s || chr(9) || t, chr(10) ORDER BY s) AS segments
FROM (SELECT graph_id, unnest([1, 2, 3, 4, 5, 6]) AS s, unnest([a1, a2, a3, b1, b2, b3]) AS t FROM thirds)
GROUP BY 1""")
def ladder_segments(spark, folder):
    segments, _, _ = ladder_graph(ladders(written_bundles(spark, folder)))
    line = F.concat(F.lit("S\t"), F.col("segment_id").cast("string"), F.lit("\t"), F.col("sequence"))
    ordered = F.array_sort(F.collect_list(F.struct("segment_id", line.alias("line"))))
    return segments.groupBy("graph_id").agg(F.array_join(ordered["line"], "\n").alias("segments"))


def min_over(texts: list[str]) -> str:
    return "least(" + ", ".join(f"levenshtein({t}, left(pattern, v))" for t in texts) + ")"


# a cell is the best over all ways to spell what lies before it in the ladder
LADDER_CELLS = f"WITH {LADDERS}, sized AS (SELECT *, unnest(range(0, len(pattern) + 1)) AS v FROM thirds)" + " UNION ALL ".join(
    f"""
SELECT graph_id, {segment}::BIGINT AS segment, h, v, {min_over([before + f"left({text}, h)" for before in ways])} AS score
FROM (SELECT *, unnest(range(0, len({text}) + 1)) AS h FROM sized)"""
    for column, ways in enumerate([
        [""],
        ["a1 || ", "b1 || "],
        [f"{x}1 || {y}2 || " for x in "ab" for y in "ab"],
    ])
    for segment, text in ((column + 1, f"a{column + 1}"), (column + 4, f"b{column + 1}"))
)


@query(LADDER_CELLS)
def dag_score_cells(spark, folder):
    segments, edges, queries = ladder_graph(ladders(written_bundles(spark, folder)))
    return graph_align.table_cells(queries, segments, edges).drop("query_id")


# the furthest place on a diagonal with so many edits, up to the distance
@query(f"""WITH cells AS ({LADDER_CELLS}),
ends AS (SELECT graph_id, {LADDER_SCORE} AS final FROM (WITH {LADDERS} SELECT * FROM thirds))
SELECT graph_id, score::INT AS distance, segment, (h - v)::INT AS k, max(h)::INT AS reach
FROM cells JOIN ends USING (graph_id) WHERE score <= final GROUP BY ALL""")
def dag_wavefront_cells(spark, folder):
    segments, edges, queries = ladder_graph(ladders(written_bundles(spark, folder)))
    return graph_align.front_cells(queries, segments, edges).drop("query_id")


@query(f"""WITH {READS} SELECT count(*) AS sequences, sum(len(seq))::BIGINT AS symbols, 0::BIGINT AS problems FROM reads""")
def alignment_check(spark, folder):
    sequences = star_sequences(written_bundles(spark, folder))
    problems = checks.alignment_problems(sequences).groupBy("graph_id", "seq_rank").agg(F.count("*").alias("found"))
    return sequences.join(problems, ["graph_id", "seq_rank"], "left").agg(
        F.count("*").alias("sequences"),
        F.sum(F.length("seq")).alias("symbols"),
        F.sum(F.coalesce("found", F.lit(0))).alias("problems"),
    )


@query(f"""WITH {READS} SELECT sum(2 * (len(seq) - 1))::BIGINT AS weight, 0::BIGINT AS violations FROM reads""")
def edge_check(spark, folder):
    graph = written_graph(spark, folder, "star")
    edges = graph.edges()
    return evidence(edges, checks.dangling_edges(graph.nodes, edges))


TO_QUERY_END = f"""WITH cells AS ({LADDER_CELLS}),
asked AS (SELECT graph_id, length(pattern) AS n FROM (WITH {LADDERS} SELECT * FROM thirds))
SELECT graph_id, min(score)::BIGINT AS score, true AS valid FROM cells JOIN asked USING (graph_id) WHERE v = n GROUP BY 1"""


def ladder_to_query_end(spark: SparkSession, folder: str, method: str) -> DataFrame:
    """The best alignment that may stop anywhere in the ladder, its operations counted and replayed."""
    segments, edges, queries = ladder_graph(materialise_graph(ladders(written_bundles(spark, folder)), "rungs"))
    found = graph_align.align_graphs(queries, segments, edges, method, end="query")
    steps = found.select("graph_id", "score", F.posexplode("path").alias("at", "step"))
    spelled = (
        steps.select("graph_id", "score", "at", F.col("step.segment").alias("segment_id"), "step.ops")
        .join(segments, ["graph_id", "segment_id"])
        .groupBy("graph_id", "score")
        .agg(F.array_sort(F.collect_list(F.struct("at", "ops", "sequence"))).alias("s"))
        .select("graph_id", "score", F.array_join("s.ops", "").alias("ops"), F.array_join("s.sequence", "").alias("text"))
        .join(queries, "graph_id")
    )
    # the last segment may be used in part
    used = F.length(F.regexp_replace("ops", "D", ""))
    text, ops = F.substr(F.col("text"), F.lit(1), used), F.col("ops")
    valid = cigar.is_valid(ops, F.col("pattern"), text) & (cigar.edit_score(ops) == F.col("score"))
    return spelled.select("graph_id", "score", valid.alias("valid"))


@query(TO_QUERY_END)
def dag_distance_to_query_end(spark, folder):
    return ladder_to_query_end(spark, folder, "table")


@query(TO_QUERY_END)
def dag_distance_to_query_end_wavefront(spark, folder):
    return ladder_to_query_end(spark, folder, "wavefront")


@query(TO_QUERY_END)
def dag_distance_to_query_end_by_level(spark, folder):
    return ladder_to_query_end(spark, folder, "levels")


# position-wise graphs spell each of their own sequences from a source on
@query(f"WITH {READS} SELECT graph_id, seq_rank, 0::BIGINT AS score FROM reads")
def po_graph_distance_to_query_end(spark, folder):
    graph = graph_of(spark, folder)
    asked = reads(written_bundles(spark, folder)).select(
        "graph_id", F.col("seq_rank").alias("query_id"), F.col("seq").alias("pattern")
    )
    nodes = graph_align.node_graph(graph.nodes)
    found = graph_align.align_graphs(asked, nodes, graph.edges(), end="query")
    return found.select("graph_id", F.col("query_id").alias("seq_rank"), "score")


@query(f"""{STAR_DISTANCE} SELECT graph_id, seq_rank, list_min(list_transform(
list_filter(range(1, n::BIGINT + 1), lambda i: p.ends[i]), lambda i: cols[i][len(pattern) + 1]))::BIGINT AS score
FROM dp d JOIN packed p USING (graph_id) WHERE d.r = p.n""")
def po_graph_distance(spark, folder):
    graph = written_graph(spark, folder, "star")
    asked = reads(written_bundles(spark, folder)).select(
        "graph_id", F.col("seq_rank").alias("query_id"), F.col("seq").alias("pattern")
    )
    nodes = graph_align.node_graph(graph.nodes)
    found = graph_align.align_graphs(asked, nodes, graph.edges(), "wavefront")
    return found.select("graph_id", F.col("query_id").alias("seq_rank"), "score")


REVERSED = STAR_DISTANCE.replace(
    "seq_rank, seq AS pattern, 0::BIGINT AS r, []::BIGINT[][] AS cols FROM reads",
    "0 AS seq_rank, reverse(string_agg(seq, '' ORDER BY seq_rank)) AS pattern, 0::BIGINT AS r, []::BIGINT[][] AS cols "
    "FROM reads GROUP BY graph_id",
)


@query(f"""{REVERSED} SELECT graph_id, list_min(list_transform(
list_filter(range(1, n::BIGINT + 1), lambda i: p.ends[i]), lambda i: cols[i][len(pattern) + 1]))::BIGINT AS score,
0::BIGINT AS difference FROM dp d JOIN packed p USING (graph_id) WHERE d.r = p.n""")
def graph_aligners_agree(spark, folder):
    graph = written_graph(spark, folder, "star")
    asked = written_bundles(spark, folder).select(
        "graph_id", F.lit(0).alias("query_id"), F.reverse(F.array_join("seqs", "")).alias("pattern")
    )
    nodes, edges = graph_align.node_graph(graph.nodes), graph.edges()
    by_table = graph_align.align_graphs(asked, nodes, edges, "table").select("graph_id", "score")
    by_waves = graph_align.align_graphs(asked, nodes, edges, "wavefront")
    return by_table.join(by_waves.select("graph_id", F.col("score").alias("other")), "graph_id").select(
        "graph_id", "score", (F.col("score") - F.col("other")).alias("difference")
    )


GROWN = """WITH talks AS (SELECT conv_id AS graph_id, turn, text, turn - min(turn) OVER (PARTITION BY conv_id) AS seq_rank
FROM conversations WHERE text <> '')"""


def grown_talks(spark: SparkSession, folder: str) -> tuple[PoGraph, DataFrame]:
    """Whole conversations, every turn aligned to the graph of those before it."""
    turns = table(spark, folder, "conversations", "conv_id", "turn", "text").filter("text <> ''")
    first = turns.groupBy("conv_id").agg(F.min("turn").alias("first"))
    return aligned_growth(
        turns.join(first, "conv_id").select(
            F.col("conv_id").alias("graph_id"), (F.col("turn") - F.col("first")).alias("seq_rank"), F.col("text").alias("seq")
        )
    )


@query(f"{GROWN} SELECT graph_id, seq_rank::INT AS seq_rank, text, 0::BIGINT AS jumps FROM talks")
def grown_conversation_texts(spark, folder):
    """What the paths spell, and their steps that are no edge forward in a topological order."""
    graph, _ = grown_talks(spark, folder)
    ranks = ranking.ranks(graph.nodes, graph.edges())
    return seg.spelled_paths(graph.paths, graph.nodes, ranks).select("graph_id", "seq_rank", "text", F.col("late").alias("jumps"))


@query(f"""{GROWN} SELECT graph_id, count(*) AS sequences, sum(2 * (len(text) - 1))::BIGINT AS weight,
0::BIGINT AS unexplained FROM talks GROUP BY 1""")
def grown_conversation_weights(spark, folder):
    """Edge weights, and the new nodes of each graph that the edits of its alignments do not explain."""
    graph, scores = grown_talks(spark, folder)
    weights = graph.edges().groupBy("graph_id").agg(F.sum("weight").alias("weight"))
    made = graph.nodes.groupBy("graph_id").agg(F.count("*").alias("nodes"))
    told = scores.groupBy("graph_id").agg(F.count("*").alias("sequences"), F.sum("score").alias("edits"))
    over = F.greatest(F.col("nodes") - F.col("edits"), F.lit(0)).cast("long")
    return told.join(made, "graph_id").join(weights, "graph_id", "left").select(
        "graph_id", "sequences", F.coalesce("weight", F.lit(0)).alias("weight"), over.alias("unexplained")
    )


# the graph of one read is a chain
@query(f"WITH {READS} SELECT graph_id, seq_rank, CASE seq_rank WHEN 0 THEN len(seq) ELSE levenshtein(seq, first) END::BIGINT AS score "
       "FROM (SELECT *, first_value(seq) OVER (PARTITION BY graph_id ORDER BY seq_rank) AS first FROM reads) WHERE seq_rank <= 1")
def grown_bundle_first_scores(spark, folder):
    _, scores = aligned_growth(reads(written_bundles(spark, folder)).select("graph_id", "seq_rank", "seq"))
    return scores.filter("seq_rank <= 1").select("graph_id", F.col("seq_rank").cast("long").alias("seq_rank"), "score")


# every two nodes that reach each other, by distinct reachable pairs
@query("""WITH RECURSIVE steps AS (SELECT DISTINCT user_id AS graph_id, event_type AS src,
  lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
links AS (SELECT graph_id, src, dst FROM steps WHERE dst IS NOT NULL AND src <= dst),
reach AS (SELECT * FROM links UNION SELECT r.graph_id, r.src, l.dst FROM reach r JOIN links l ON l.graph_id = r.graph_id AND l.src = r.dst)
SELECT graph_id, src AS node_id, src AS component, 1::BIGINT AS size FROM reach WHERE src = dst""")
def forward_event_cycles(spark, folder):
    """Steps to no smaller event type: what is left on a cycle leads to itself."""
    return cycles(event_steps(spark, folder).filter("src <= dst"))


@query("""WITH RECURSIVE steps AS (SELECT DISTINCT user_id AS graph_id, event_type AS src,
  lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
links AS (SELECT graph_id, src, dst FROM steps WHERE dst IS NOT NULL),
reach AS (SELECT * FROM links UNION SELECT r.graph_id, r.src, l.dst FROM reach r JOIN links l ON l.graph_id = r.graph_id AND l.src = r.dst)
SELECT a.graph_id, a.src AS node_id, min(a.dst) AS component, count(*) AS size
FROM reach a JOIN reach b ON b.graph_id = a.graph_id AND b.src = a.dst AND b.dst = a.src
WHERE EXISTS (SELECT 1 FROM reach c WHERE c.graph_id = a.graph_id AND c.src = a.src AND c.dst = a.src) GROUP BY 1, 2""")
def event_cycles(spark, folder):
    """Event types of each user that lie on a cycle of the steps from one type to the next."""
    return cycles(event_steps(spark, folder))


def event_steps(spark: SparkSession, folder: str) -> DataFrame:
    """graph_id (user), src, dst: the types of every two consecutive events."""
    events = table(spark, folder, "events", "user_id", "ts", "event_id", "event_type")
    numbered = materialise_graph(number_within(events, ["user_id"], ["ts", "event_id"]), "numbered")
    following = numbered.select("user_id", (F.col("pos") - 1).alias("pos"), F.col("event_type").alias("dst"))
    return numbered.join(following, ["user_id", "pos"]).select(
        F.col("user_id").alias("graph_id"), F.col("event_type").alias("src"), "dst"
    )


@query("SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY section, major, minor, detail) - 1 AS line_no, line FROM ("
       + gfa_sql(f"WITH {GRAPH}", 0) + ")")
def gfa_files(spark, folder):
    """GFA files, one a graph, written by the data source and read back line by line."""
    graph = graph_of(spark, folder)
    nodes = graph.nodes.withColumnRenamed("symbol", "sequence")
    lines = export.gfa_lines(nodes, graph.edges(), graph.paths, ranks_of(spark, folder))
    spark.dataSource.register(GraphFiles)
    out = f"{shared_folder(spark)}/gfa-{uuid.uuid4().hex}"
    in_line_order(lines).write.format("graph_files").mode("append").save(out)
    return read_lines(spark, out).select(F.col("name").cast("long").alias("graph_id"), "line_no", "line")
