"""Registered queries: sequences, pairwise distances and edit scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seqloom.functions import cigar
from seqloom.functions.text import distance, distance_by_fold, distance_within
from seqloom.operators.pairwise import align, align_wavefront, edit_distance, score_cells, score_rows, score_lines, wavefront_cells
from seqloom.plans.oracle import LINES, READS, SCRIPT, SCRIPTS
from seqloom.plans.registry import query
from seqloom.session import spread
from seqloom.sources.reads import event_bundles, read_pairs, reads, written_bundles
from seqloom.sources.tables import table

NEAR = 10  # edits within which two strings count as near
BAND = 10

def ab() -> tuple[Column, Column]:
    return F.col("a"), F.col("b")


def pairs_of(spark: SparkSession, folder: str) -> DataFrame:
    return read_pairs(written_bundles(spark, folder))


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, line_no, a, b: every line with the next one; row-local, whole texts."""
    lines = spread(table(spark, folder, "documents", "doc_id", "text")).withColumn("lines", F.split("text", "\n"))
    following = F.expr(
        "zip_with(slice(lines, 1, size(lines) - 1), slice(lines, 2, size(lines)), (a, b) -> struct(a, b))"
    )
    return (
        lines.filter(F.contains("text", F.lit("\n")))
        .select("doc_id", F.posexplode(following).alias("line_no", "pair"))
        .select("doc_id", "line_no", "pair.a", "pair.b")
    )


def aligned_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return pairs_of(spark, folder).withColumn("al", align(*ab())).select(
        "graph_id", "seq_rank", "a", "b", "al.score", "al.ops"
    )


@query(f"WITH {READS} SELECT graph_id, seq_rank, seq FROM reads")
def event_sequences(spark, folder):
    return reads(event_bundles(spark, folder))


@query(f"WITH {READS} SELECT graph_id, seq_rank, levenshtein(a, b) AS distance FROM pairs")
def pairwise_distance(spark, folder):
    return pairs_of(spark, folder).select("graph_id", "seq_rank", distance(*ab()).alias("distance"))


@query(f"""WITH {READS} SELECT graph_id, seq_rank, levenshtein(a, b) AS distance FROM pairs
WHERE levenshtein(a, b) <= {NEAR}""")
def pairwise_within_threshold(spark, folder):
    near = distance_within(*ab(), NEAR).alias("distance")
    return pairs_of(spark, folder).select("graph_id", "seq_rank", near).filter("distance is not null")


@query(f"WITH {READS} SELECT graph_id, seq_rank, levenshtein(a, b) AS distance FROM pairs")
def distance_linear_space_fold(spark, folder):
    return pairs_of(spark, folder).select("graph_id", "seq_rank", distance_by_fold(*ab()).alias("distance"))


@query(f"""WITH {LINES} SELECT doc_id, line_no, levenshtein(a, b) AS distance FROM line_pairs""")
def document_byte_distance(spark, folder):
    return document_lines(spark, folder).select("doc_id", "line_no", edit_distance(*ab()).alias("distance"))


@query("""SELECT a.doc_id, levenshtein(a.text, b.text) AS distance
FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1""")
def whole_document_distance(spark, folder):
    documents = spread(table(spark, folder, "documents", "doc_id", "text"))
    following = documents.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("b"))
    return documents.join(following, "doc_id").select("doc_id", edit_distance(F.col("text"), F.col("b")).alias("distance"))


@query(f"""WITH {LINES} SELECT doc_id, line_no, levenshtein(a, b) AS distance FROM line_pairs
WHERE abs(strlen(a) - strlen(b)) <= {NEAR} AND levenshtein(a, b) <= {NEAR}""")
def document_lines_within_threshold(spark, folder):
    near = distance_within(*ab(), NEAR).alias("distance")
    return document_lines(spark, folder).select("doc_id", "line_no", near).filter("distance is not null")


@query("""SELECT a.conv_id, a.turn, levenshtein(a.text, b.text) AS distance
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def conversation_turn_distance(spark, folder):
    turns = spread(table(spark, folder, "conversations", "conv_id", "turn", "text"))
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    # (conv_id, turn) is unique, so the join has no heavy key
    return turns.join(following, ["conv_id", "turn"]).select(
        "conv_id", "turn", edit_distance(F.col("text"), F.col("b")).alias("distance")
    )


@query("""SELECT a.page_id, levenshtein(a.url, b.url) AS distance
FROM pages a JOIN pages b ON b.page_id = a.page_id + 1""")
def url_character_distance(spark, folder):
    pages = table(spark, folder, "pages", "page_id", "url")
    following = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("b"))
    return pages.join(following, "page_id").select(
        "page_id", distance(F.col("url"), F.col("b"), unit="char").alias("distance")
    )


@query(f"WITH {READS} SELECT graph_id, seq_rank, levenshtein(a, b) AS distance FROM pairs")
def wfa_distance(spark, folder):
    return pairs_of(spark, folder).select(
        "graph_id", "seq_rank", align_wavefront(*ab())["score"].alias("distance")
    )


def same_kind(p, t, v, h):
    """Purchase and signup count as the same kind of event."""
    as_kind = lambda s: s + (s == ord("S")) * (ord("P") - ord("S"))
    return as_kind(p) == as_kind(t)


@query(f"""WITH {READS} SELECT graph_id, seq_rank,
levenshtein(translate(a, 'S', 'P'), translate(b, 'S', 'P')) AS distance FROM pairs""")
def wfa_lambda_distance(spark, folder):
    return pairs_of(spark, folder).select(
        "graph_id", "seq_rank", align_wavefront(*ab(), match=same_kind)["score"].alias("distance")
    )


@query(f"""WITH {READS} SELECT graph_id, seq_rank,
CASE WHEN levenshtein(a, b) <= {BAND} THEN levenshtein(a, b) END AS distance FROM pairs""")
def banded_distance(spark, folder):
    score = F.col("al.score")
    return pairs_of(spark, folder).withColumn("al", align(*ab(), bandwidth=BAND)).select(
        "graph_id", "seq_rank", F.when(score <= BAND, score).alias("distance")
    )


# no text holds the control character, so every full stop must be edited, and that is enough
@query("""SELECT doc_id, length(text) - length(replace(text, '.', '')) AS score, true AS valid FROM documents""")
def document_wavefront(spark, folder):
    """Whole documents against a near copy, aligned by wavefronts whatever their length."""
    docs = spread(table(spark, folder, "documents", "doc_id", "text"))
    near = docs.withColumn("near", F.replace("text", F.lit("."), F.lit("\x01")))
    al = near.withColumn("al", align_wavefront(F.col("text"), F.col("near")))
    ops = F.col("al.ops")
    valid = cigar.is_valid(ops, F.col("text"), F.col("near"))
    return al.select("doc_id", F.col("al.score").alias("score"), valid.alias("valid"))


@query(f"""WITH {READS} SELECT graph_id, seq_rank, levenshtein(a, b) AS score, true AS valid FROM pairs
WHERE levenshtein(a, b) <= {BAND}""")
def banded_script_check(spark, folder):
    """Scripts of the banded alignment, replayed, wherever the distance is within the band."""
    al = pairs_of(spark, folder).withColumn("al", align(*ab(), bandwidth=BAND)).filter(F.col("al.score") <= BAND)
    ops = F.col("al.ops")
    return al.select("graph_id", "seq_rank", cigar.edit_score(ops).alias("score"), cigar.is_valid(ops, *ab()).alias("valid"))


@query(f"""WITH {LINES} SELECT doc_id, line_no, levenshtein(a, b) AS score,
strlen(a) AS pattern_used, strlen(b) AS text_used FROM line_pairs""")
def document_line_alignment(spark, folder):
    al = document_lines(spark, folder).withColumn("al", align(*ab()))
    used = lambda skip: F.length(F.replace("al.ops", F.lit(skip), F.lit(""))).cast("long")
    return al.select(
        "doc_id", "line_no", cigar.edit_score(F.col("al.ops")).alias("score"),
        used("I").alias("pattern_used"), used("D").alias("text_used"),
    )


@query(f"WITH {READS} SELECT graph_id, seq_rank, levenshtein(a, b) AS score FROM pairs")
def cigar_score(spark, folder):
    return aligned_pairs(spark, folder).select(
        "graph_id", "seq_rank", cigar.edit_score(F.col("ops")).alias("score")
    )


@query(f"WITH {READS} SELECT graph_id, seq_rank, levenshtein(a, b) AS score, true AS valid FROM pairs")
def cigar_check(spark, folder):
    ops = F.col("ops")
    return aligned_pairs(spark, folder).select(
        "graph_id", "seq_rank", cigar.edit_score(ops).alias("score"), cigar.is_valid(ops, *ab()).alias("valid")
    )


@query(f"WITH {READS} SELECT graph_id, seq_rank, levenshtein(a, b) AS score, true AS valid FROM pairs")
def wfa_cigar_check(spark, folder):
    return pairs_of(spark, folder).withColumn("al", align_wavefront(*ab())).select(
        "graph_id", "seq_rank", cigar.edit_score(F.col("al.ops")).alias("score"),
        cigar.is_valid(F.col("al.ops"), *ab()).alias("valid"),
    )


@query(f"""{SCRIPT} SELECT graph_id, seq_rank, array_to_string(list_transform(
regexp_extract_all(ops, 'M+|X+|I+|D+'), lambda r: len(r)::VARCHAR || left(r, 1)), '') AS cigar FROM scripts""")
def cigar_text(spark, folder):
    return aligned_pairs(spark, folder).select(
        "graph_id", "seq_rank", cigar.compact(F.col("ops")).alias("cigar")
    )


def scripts(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, ops: the letters of every whole document read as edit operations."""
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    return spread(table(spark, folder, "documents", "doc_id", "text")).select(
        "doc_id",
        F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "MXMDMIMMMXMMMDXMXMMIDXMMIM").alias("ops"),
    )


@query(f"""WITH {SCRIPTS} SELECT doc_id, len(regexp_replace(ops, '[^M]', '', 'g')) AS matches,
len(regexp_replace(ops, '[^XID]', '', 'g')) AS score FROM scripts""")
def cigar_matches(spark, folder):
    ops = F.col("ops")
    return scripts(spark, folder).select(
        "doc_id", cigar.matches(ops).alias("matches"), cigar.edit_score(ops).alias("score")
    )


@query(f"""WITH {SCRIPTS} SELECT doc_id, array_to_string(list_transform(
regexp_extract_all(ops, 'M+|X+|I+|D+'), lambda r: len(r)::VARCHAR || left(r, 1)), '') AS cigar FROM scripts""")
def cigar_rle(spark, folder):
    return scripts(spark, folder).select("doc_id", cigar.compact(F.col("ops")).alias("cigar"))


@query(f"""WITH {SCRIPTS} SELECT doc_id, 'DD' || 'III' || ops AS ops FROM scripts""")
def cigar_leading(spark, folder):
    return scripts(spark, folder).select(
        "doc_id", cigar.leading(F.col("ops"), insertions=F.lit(3), deletions=F.lit(2)).alias("ops")
    )


# lines of four languages, so characters of one to three bytes; scripts of either unit
@query(f"""WITH {LINES} SELECT lang, unit, count(*) AS pairs, count(*) AS valid,
sum(CASE WHEN unit = 'byte' THEN levenshtein(a, b) END)::BIGINT AS byte_score
FROM line_pairs JOIN documents USING (doc_id), (VALUES ('byte'), ('char')) u(unit) GROUP BY lang, unit""")
def document_script_check(spark, folder):
    langs = table(spark, folder, "documents", "doc_id", "lang")
    lines = document_lines(spark, folder)
    # characters of one byte each have one script in either unit, so the other lines alone are aligned again
    plain = (F.octet_length("a") == F.length("a")) & (F.octet_length("b") == F.length("b"))
    by_byte = lines.withColumn("byte", align(*ab(), unit="byte"))
    by_char = by_byte.withColumn("char", align(*(F.when(~plain, c) for c in ab()), unit="char"))
    checked = by_char.select(
        "doc_id", F.col("byte.score").alias("score"), cigar.is_valid(F.col("byte.ops"), *ab(), unit="byte").cast("long").alias("byte"),
        cigar.is_valid(F.when(plain, F.col("byte.ops")).otherwise(F.col("char.ops")), *ab(), unit="char").cast("long").alias("char"),
    )
    # counted by document before languages are looked up, so no line is moved
    names = ["pairs", "byte", "char", "score"]
    own = checked.groupBy("doc_id").agg(F.count("*").alias("pairs"), *[F.sum(c).alias(c) for c in names[1:]])
    each = own.join(langs, "doc_id").groupBy("lang").agg(*[F.sum(c).alias(c) for c in names])
    none = F.lit(None).cast("long")
    units = [F.struct(F.lit(u).alias("unit"), "pairs", F.col(u).alias("valid"), s.alias("byte_score")) for u, s in (("byte", F.col("score")), ("char", none))]
    return each.select("lang", F.inline(F.array(*units)))


PLACED = """array_to_string(list_transform(range(1, least({n}, {m}) + 1),
lambda i: CASE WHEN {x} = {y} THEN 'M' ELSE 'X' END), '')
|| repeat('D', greatest({n} - {m}, 0)) || repeat('I', greatest({m} - {n}, 0))"""
BY_CHAR = PLACED.format(n="len(ca)", m="len(cb)", x="ca[i]", y="cb[i]")
BY_BYTE = PLACED.format(n="len(xa)", m="len(xb)", x="xa[i]", y="xb[i]")


@query(f"""WITH {LINES}, lists AS (SELECT *, regexp_extract_all(a, '(?s).') AS ca, regexp_extract_all(b, '(?s).') AS cb,
regexp_extract_all(hex(encode(a)), '..') AS xa, regexp_extract_all(hex(encode(b)), '..') AS xb FROM line_pairs)
SELECT doc_id, line_no, {BY_BYTE} AS by_byte, {BY_CHAR} AS by_char,
a || repeat('-', greatest(len(b) - len(a), 0)) AS upper_row, translate({BY_CHAR}, 'MXDI', '|   ') AS sign_row,
b || repeat('-', greatest(len(a) - len(b), 0)) AS lower_row FROM lists""")
def document_lines_refined(spark, folder):
    """Lines laid over each other, in bytes and in characters."""
    lines = document_lines(spark, folder)
    matches = F.repeat(F.lit("M"), F.greatest(F.octet_length("a"), F.octet_length("b")))
    by_char = cigar.refine(F.repeat(F.lit("M"), F.least(F.length("a"), F.length("b"))), *ab(), unit="char")
    refined = lines.select("*", cigar.refine(matches, *ab()).alias("by_byte"), by_char.alias("by_char"))
    drawn = refined.withColumn("p", cigar.pretty(F.col("by_char"), *ab(), unit="char"))
    return drawn.select(
        "doc_id", "line_no", "by_byte", "by_char", F.col("p.pattern").alias("upper_row"),
        F.col("p.ops").alias("sign_row"), F.col("p.text").alias("lower_row"),
    )


@query(f"""WITH {READS} SELECT graph_id, seq_rank, (CASE WHEN len(a) <> len(b) THEN len(a) - len(b)
WHEN a = b THEN 0 ELSE list_filter(list_transform(range(1, len(a) + 1), lambda i: ascii(a[i]) - ascii(b[i])),
lambda d: d <> 0)[1] END)::BIGINT AS comparison FROM pairs""")
def cigar_compare(spark, folder):
    return pairs_of(spark, folder).select("graph_id", "seq_rank", cigar.compare(*ab()).alias("comparison"))


REFINED = """array_to_string(list_transform(range(1, least(len(a), len(b)) + 1),
lambda i: CASE WHEN a[i] = b[i] THEN 'M' ELSE 'X' END), '')
|| repeat('D', greatest(len(a) - len(b), 0)) || repeat('I', greatest(len(b) - len(a), 0))"""


def refined_pairs(spark: SparkSession, folder: str) -> DataFrame:
    plain = F.repeat(F.lit("M"), F.least(F.length("a"), F.length("b")))
    return pairs_of(spark, folder).withColumn("ops", cigar.refine(plain, *ab()))


@query(f"WITH {READS} SELECT graph_id, seq_rank, {REFINED} AS ops FROM pairs")
def cigar_refine(spark, folder):
    return refined_pairs(spark, folder).select("graph_id", "seq_rank", "ops")


@query(f"""WITH {READS} SELECT graph_id, seq_rank,
a || repeat('-', greatest(len(b) - len(a), 0)) AS pattern_row,
translate({REFINED}, 'MXDI', '|   ') AS ops_row,
b || repeat('-', greatest(len(a) - len(b), 0)) AS text_row FROM pairs""")
def cigar_pretty(spark, folder):
    drawn = refined_pairs(spark, folder).withColumn("p", cigar.pretty(F.col("ops"), *ab()))
    return drawn.select(
        "graph_id", "seq_rank", F.col("p.pattern").alias("pattern_row"),
        F.col("p.ops").alias("ops_row"), F.col("p.text").alias("text_row"),
    )


CELLS = f"""{READS},
cells AS (
  SELECT graph_id, seq_rank, h, v, len(b) AS m, len(a) AS n, levenshtein(left(a, v), left(b, h)) AS score
  FROM (SELECT *, unnest(range(0, len(a) + 1)) AS v FROM
         (SELECT *, unnest(range(0, len(b) + 1)) AS h FROM pairs)))"""


@query(f"WITH {CELLS} SELECT graph_id, seq_rank, h, v, score FROM cells")
def score_matrix_cells(spark, folder):
    return score_rows(pairs_of(spark, folder), "a", "b")


@query(f"""WITH {CELLS}
SELECT graph_id, seq_rank, -2 AS line_no, repeat(' ', 7) || array_to_string(list_transform(
  range(1, len(b) + 1), lambda i: '  ' || b[i] || '  '), '') AS line FROM pairs
UNION ALL SELECT graph_id, seq_rank, -1, ' ' || string_agg(printf(' %3d ', h), '' ORDER BY h) FROM cells WHERE v = 0
GROUP BY 1, 2
UNION ALL SELECT c.graph_id, c.seq_rank, v, CASE WHEN v = 0 THEN ' ' ELSE any_value(p.a)[v] END
  || string_agg(printf(' %3d ', score), '' ORDER BY h) FROM cells c JOIN pairs p USING (graph_id, seq_rank)
GROUP BY 1, 2, 3""")
def score_matrix_text(spark, folder):
    tables = pairs_of(spark, folder).withColumn("cells", score_cells(*ab()))
    return tables.select(
        "graph_id", "seq_rank", F.posexplode(score_lines(*ab(), F.col("cells"))).alias("at", "line")
    ).select("graph_id", "seq_rank", (F.col("at") - 2).cast("long").alias("line_no"), "line")


@query(f"""WITH {CELLS},
final AS (SELECT graph_id, seq_rank, levenshtein(a, b) AS last FROM pairs)
SELECT c.graph_id, c.seq_rank, d.distance, c.h - c.v AS k, max(c.h) AS reach
FROM cells c JOIN final f USING (graph_id, seq_rank),
     LATERAL (SELECT unnest(range(0, f.last + 1)) AS distance) d
WHERE c.score <= d.distance AND abs(c.h - c.v) <= d.distance
GROUP BY ALL""")
def wavefront_trace(spark, folder):
    return (
        pairs_of(spark, folder)
        .select("graph_id", "seq_rank", F.explode(wavefront_cells(*ab())).alias("cell"))
        .select("graph_id", "seq_rank", "cell.*")
    )
