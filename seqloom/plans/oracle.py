"""ANSI SQL that gives the same rows as the registered queries."""

from __future__ import annotations

# reads: graph_id, seq_rank, seq; bases: one row per symbol
READS = """
ev AS (
  SELECT user_id, event_id, upper(left(event_type, 1)) AS symbol,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n
  FROM events),
keyed AS (
  SELECT user_id, n, symbol, min(event_id) OVER (PARTITION BY user_id, n // 128) AS graph_id FROM ev),
reads AS (
  SELECT graph_id, (n % 128) // 16 AS seq_rank, string_agg(symbol, '' ORDER BY n) AS seq, user_id, n // 16 AS read_no
  FROM keyed GROUP BY graph_id, user_id, n // 16, (n % 128) // 16),
pairs AS (
  SELECT a.graph_id, a.seq_rank, a.seq AS a, b.seq AS b
  FROM reads a JOIN reads b ON a.user_id = b.user_id AND b.read_no = a.read_no + 1)"""

# nodes of the position-wise graph: one per (position, symbol), numbered by first use
GRAPH = READS + """,
bases AS (
  SELECT graph_id, (n % 128) // 16 AS seq_rank, n % 16 AS pos, symbol FROM keyed),
made AS (
  SELECT graph_id, pos, symbol, min(seq_rank) AS made FROM bases GROUP BY 1, 2, 3),
nodes AS (
  SELECT graph_id, pos, symbol, made,
         row_number() OVER (PARTITION BY graph_id ORDER BY made, pos) - 1 AS node_id,
         row_number() OVER (PARTITION BY graph_id ORDER BY pos, made) - 1 AS rank FROM made),
paths AS (
  SELECT b.graph_id, b.seq_rank, b.pos, n.node_id, n.rank, n.symbol
  FROM bases b JOIN nodes n ON b.graph_id = n.graph_id AND b.pos = n.pos AND b.symbol = n.symbol),
steps AS (
  SELECT p.graph_id, p.seq_rank AS label, p.node_id AS src, q.node_id AS dst,
         p.rank AS src_rank, q.rank AS dst_rank, p.symbol AS src_symbol, q.symbol AS dst_symbol
  FROM paths p JOIN paths q
    ON p.graph_id = q.graph_id AND p.seq_rank = q.seq_rank AND q.pos = p.pos + 1),
edges AS (
  SELECT graph_id, src, dst, src_rank, dst_rank, src_symbol, dst_symbol,
         2 * count(*) AS weight, min(label) AS ord, count(*) AS n
  FROM steps GROUP BY ALL)"""

LADDERS = READS + """,
rungs AS (
  SELECT a.graph_id * 8 + a.seq_rank AS graph_id, a.seq AS a, b.seq AS b, c.seq AS pattern
  FROM reads a JOIN reads b ON a.user_id = b.user_id AND b.read_no = a.read_no + 1
               JOIN reads c ON a.user_id = c.user_id AND c.read_no = a.read_no + 2),
thirds AS (
  SELECT graph_id, pattern,
         left(a, len(a) // 3) AS a1, a[len(a) // 3 + 1 : 2 * len(a) // 3] AS a2, a[2 * len(a) // 3 + 1 :] AS a3,
         left(b, len(b) // 3) AS b1, b[len(b) // 3 + 1 : 2 * len(b) // 3] AS b2, b[2 * len(b) // 3 + 1 :] AS b3
  FROM rungs)"""

LADDER_SCORE = "least(" + ", ".join(
    f"levenshtein({x}1 || {y}2 || {z}3, pattern)" for x in "ab" for y in "ab" for z in "ab"
) + ")"

LINES = """
lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no,
         unnest(string_split(text, chr(10))) AS line FROM documents),
line_pairs AS (
  SELECT a.doc_id, a.line_no, a.line AS a, b.line AS b
  FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND b.line_no = a.line_no + 1)"""

SCRIPTS = """
scripts AS (
  SELECT doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'),
                           'abcdefghijklmnopqrstuvwxyz', 'MXMDMIMMMXMMMDXMXMMIDXMMIM') AS ops
  FROM documents)"""


def hundredths_sql(value: str, factor: int, width: int = 0) -> str:
    """Two decimals in whole-number arithmetic, ties upwards."""
    up = f"(({value})::HUGEINT * 100 + {factor // 2}) // {factor}"
    text = f"(({up}) // 100)::VARCHAR || '.' || lpad((({up}) % 100)::VARCHAR, 2, '0')"
    return f"lpad({text}, greatest({width}, len({text}))::INT, ' ')" if width else text


def scaled_whole_sql(value: str, width: int = 0, after: str = "") -> str:
    cases = " ".join(
        f"WHEN {value} >= {factor} THEN {hundredths_sql(value, factor, width)} || '{after}{prefix}'"
        for factor, prefix in ((1_000_000_000, "G"), (1_000_000, "M"), (1_000, "K"))
    )
    return f"CASE {cases} ELSE {hundredths_sql(value, 1, width)} || '{after}' END"


def scaled_sql(value: str) -> str:
    cases = " ".join(
        f"WHEN {value} >= {factor} THEN printf('%.2f{prefix}', {value} / {factor})"
        for factor, prefix in ((1_000_000_000, "G"), (1_000_000, "M"), (1_000, "K"))
    )
    return f"CASE {cases} ELSE printf('%.2f', {value}) END"


def scaled_count_sql(value: str) -> str:
    cases = " ".join(
        f"WHEN {value} >= {factor} THEN ({value} // {factor})::VARCHAR || '{prefix}'"
        for factor, prefix in ((1_000_000_000, "G"), (1_000_000, "M"), (1_000, "K"))
    )
    return f"CASE {cases} ELSE ({value})::VARCHAR END"


# The heaviest bundle as a walk over the ranks of every graph: score node by node, take the
# first best node, and while it is no sink set its rivals aside and score what follows again.
BUNDLE = "WITH RECURSIVE " + GRAPH + """,
ins AS (SELECT graph_id, dst_rank AS rank, list({w: weight, o: ord, s: src_rank}) AS e FROM edges GROUP BY 1, 2),
rivals AS (
  SELECT x.graph_id, x.src_rank AS rank, list(DISTINCT y.src_rank) AS v
  FROM edges x JOIN edges y ON x.graph_id = y.graph_id AND x.dst = y.dst AND x.src <> y.src GROUP BY 1, 2),
inner_ AS (SELECT DISTINCT graph_id, src_rank AS rank FROM edges),
packed AS (
  SELECT n.graph_id, count(*) AS n, list(coalesce(i.e, []) ORDER BY n.rank) AS ins,
         list(coalesce(v.v, []) ORDER BY n.rank) AS rivals, list(o.rank IS NULL ORDER BY n.rank) AS sink
  FROM nodes n LEFT JOIN ins i USING (graph_id, rank) LEFT JOIN rivals v USING (graph_id, rank)
               LEFT JOIN inner_ o USING (graph_id, rank) GROUP BY 1),
walk AS (
  SELECT graph_id, 0::BIGINT AS r, 0::BIGINT AS low, false AS again, -1::BIGINT AS tip,
         list_transform(range(n), lambda x: -1::BIGINT) AS scores,
         list_transform(range(n), lambda x: NULL::BIGINT) AS preds FROM packed
  UNION ALL (
  SELECT graph_id, r + 1, low, again, -1,
         list_transform(scores, lambda x, i: CASE WHEN i = r + 1 THEN coalesce(best.w + best.c, -1) ELSE x END),
         list_transform(preds, lambda x, i: CASE WHEN i = r + 1 THEN best.s ELSE x END)
  FROM (SELECT w.*, list_max(list_transform(
            list_filter(p.ins[r + 1], lambda e: NOT again OR scores[e.s + 1] <> -1),
            lambda e: {w: e.w, c: scores[e.s + 1], o: e.o, s: e.s})) AS best
        FROM walk w JOIN packed p USING (graph_id) WHERE tip < 0 AND r < n)
  UNION ALL
  SELECT graph_id, CASE WHEN sink[top] THEN r ELSE top END, CASE WHEN sink[top] THEN low ELSE top END, true,
         CASE WHEN sink[top] THEN top - 1 ELSE -1 END,
         CASE WHEN sink[top] THEN scores ELSE list_transform(scores,
              lambda x, i: CASE WHEN list_contains(rivals[top], i - 1) THEN -1 ELSE x END) END, preds
  FROM (SELECT w.*, p.sink, p.rivals, low + list_position(scores[low + 1 :], list_max(scores[low + 1 :])) AS top
        FROM walk w JOIN packed p USING (graph_id) WHERE tip < 0 AND r = n))),
back AS (
  SELECT graph_id, tip AS rank, preds, 0 AS steps FROM walk WHERE tip >= 0
  UNION ALL
  SELECT graph_id, preds[rank + 1], preds, steps + 1 FROM back WHERE preds[rank + 1] IS NOT NULL),
bundle AS (
  SELECT b.graph_id, max(steps) OVER (PARTITION BY b.graph_id) - steps AS step, n.node_id, n.symbol
  FROM back b JOIN nodes n USING (graph_id, rank))"""

# last released first: pop the newest node, push those of its successors it sets free
NEWEST = "WITH RECURSIVE " + GRAPH + """,
outs AS (SELECT graph_id, src AS node_id, list(dst ORDER BY ord, dst) AS v FROM edges GROUP BY 1, 2),
ins AS (SELECT graph_id, dst AS node_id, count(*) AS d FROM edges GROUP BY 1, 2),
packed AS (
  SELECT n.graph_id, list(coalesce(o.v, []) ORDER BY n.node_id) AS outs,
         list(coalesce(i.d, 0) ORDER BY n.node_id) AS degree,
         list(n.node_id ORDER BY n.node_id) FILTER (i.d IS NULL) AS sources
  FROM nodes n LEFT JOIN outs o USING (graph_id, node_id) LEFT JOIN ins i USING (graph_id, node_id) GROUP BY 1),
walk AS (
  SELECT graph_id, 0::BIGINT AS rank, sources AS stack, degree FROM packed
  UNION ALL
  SELECT graph_id, rank + 1, stack[: -2] || list_filter(next, lambda x: degree[x + 1] = 1),
         list_transform(degree, lambda d, i: d - CASE WHEN list_contains(next, i - 1) THEN 1 ELSE 0 END)
  FROM (SELECT w.*, p.outs[w.stack[-1] + 1] AS next FROM walk w JOIN packed p USING (graph_id) WHERE len(w.stack) > 0))"""

# backward over the table: D before I before M before X, then what is left at the border
SCRIPT = "WITH RECURSIVE " + READS + """,
walk AS (
  SELECT graph_id, seq_rank, a, b, len(a) AS v, len(b) AS h, '' AS ops FROM pairs
  UNION ALL
  SELECT graph_id, seq_rank, a, b, v - CASE WHEN op = 'I' THEN 0 ELSE 1 END,
         h - CASE WHEN op = 'D' THEN 0 ELSE 1 END, op || ops
  FROM (SELECT *, CASE WHEN h = 0 THEN 'D' WHEN v = 0 THEN 'I'
    WHEN levenshtein(left(a, v), left(b, h)) = levenshtein(left(a, v - 1), left(b, h)) + 1 THEN 'D'
    WHEN levenshtein(left(a, v), left(b, h)) = levenshtein(left(a, v), left(b, h - 1)) + 1 THEN 'I'
    WHEN a[v] = b[h] THEN 'M' ELSE 'X' END AS op
    FROM walk WHERE v > 0 OR h > 0)),
scripts AS (SELECT graph_id, seq_rank, a, b, ops FROM walk WHERE v = 0 AND h = 0)"""

# the same walk releasing an aligned set when the last of its nodes becomes free
GROUPED = "WITH RECURSIVE " + GRAPH + """,
led AS (SELECT *, min(made) OVER (PARTITION BY graph_id, pos) AS first_made,
               min(node_id) OVER (PARTITION BY graph_id, pos) AS root FROM nodes),
peers AS (
  SELECT a.graph_id, a.node_id, list(b.node_id ORDER BY CASE WHEN b.node_id = b.root THEN a.node_id ELSE b.node_id END) AS v
  FROM led a JOIN led b ON a.graph_id = b.graph_id AND a.pos = b.pos AND a.node_id <> b.node_id GROUP BY 1, 2),
outs AS (SELECT graph_id, src AS node_id, list(dst ORDER BY ord, dst) AS v FROM edges GROUP BY 1, 2),
ins AS (SELECT graph_id, dst AS node_id, count(*) AS d FROM edges GROUP BY 1, 2),
packed AS (
  SELECT n.graph_id, list(coalesce(o.v, []) ORDER BY n.node_id) AS outs,
         list(coalesce(p.v, []) ORDER BY n.node_id) AS peers,
         list(coalesce(i.d, 0) ORDER BY n.node_id) AS degree
  FROM nodes n LEFT JOIN outs o USING (graph_id, node_id) LEFT JOIN ins i USING (graph_id, node_id)
               LEFT JOIN peers p USING (graph_id, node_id) GROUP BY 1),
walk AS (
  SELECT graph_id, 0::BIGINT AS rank, [0::BIGINT] || peers[1] AS stack, degree FROM packed
  UNION ALL
  SELECT graph_id, rank + 1, stack[: -2] || flatten(list_transform(
           list_filter(next, lambda x, i: fresh[x + 1] = 0
             AND len(list_filter(peers[x + 1], lambda y: fresh[y + 1] <> 0)) = 0
             AND len(list_filter(peers[x + 1], lambda y: list_contains(next[i + 1 :], y))) = 0),
           lambda x: [x] || peers[x + 1])), fresh
  FROM (SELECT graph_id, rank, stack, p.peers, p.outs[stack[-1] + 1] AS next,
               list_transform(w.degree, lambda d, i: d - CASE WHEN list_contains(p.outs[stack[-1] + 1], i - 1) THEN 1 ELSE 0 END) AS fresh
        FROM walk w JOIN packed p USING (graph_id) WHERE len(stack) > 0))"""

# two columns per text symbol: best cost, and cost ending in a gap along the text
AFFINE = "WITH RECURSIVE " + READS + """,
walk AS (
  SELECT graph_id, seq_rank, a, b, 0 AS h,
         [0::BIGINT] || list_transform(range(1, len(a) + 1), lambda v: 6 + 2 * v) AS best,
         list_transform(range(0, len(a) + 1), lambda v: 1000000000::BIGINT) AS gap FROM pairs
  UNION ALL
  SELECT graph_id, seq_rank, a, b, h,
         list_transform(fresh, lambda f, i: least(f, coalesce(list_min(list_transform(fresh[: i - 1],
             lambda y, j: y + 6 + 2 * (i - j))), f))), gap
  FROM (SELECT graph_id, seq_rank, a, b, h, gap,
               list_transform(gap, lambda g, i: CASE WHEN i = 1 THEN g ELSE
                 least(g, best[i - 1] + CASE WHEN a[i - 1] = b[h] THEN 0 ELSE 4 END) END) AS fresh
        FROM (SELECT graph_id, seq_rank, a, b, h + 1 AS h, best,
                     list_transform(best, lambda x, i: least(x + 6, gap[i]) + 2) AS gap
              FROM walk WHERE h < len(b))))"""

# reads aligned to the first read of their bundle, and the graph those alignments build
STAR = "WITH RECURSIVE " + READS + """,
walk AS (
  SELECT r.graph_id, r.seq_rank, f.seq AS a, r.seq AS b, len(f.seq) AS v, len(r.seq) AS h,
         NULL::BIGINT AS ref, NULL::BIGINT AS pos
  FROM reads r JOIN reads f ON f.graph_id = r.graph_id AND f.seq_rank = 0 WHERE r.seq_rank > 0
  UNION ALL
  SELECT graph_id, seq_rank, a, b, v - CASE WHEN op = 'I' THEN 0 ELSE 1 END, h - CASE WHEN op = 'D' THEN 0 ELSE 1 END,
         CASE WHEN op IN ('M', 'X') THEN v - 1 END, CASE WHEN op <> 'D' THEN h - 1 END
  FROM (SELECT *, CASE WHEN h = 0 THEN 'D' WHEN v = 0 THEN 'I'
    WHEN levenshtein(left(a, v), left(b, h)) = levenshtein(left(a, v - 1), left(b, h)) + 1 THEN 'D'
    WHEN levenshtein(left(a, v), left(b, h)) = levenshtein(left(a, v), left(b, h - 1)) + 1 THEN 'I'
    WHEN a[v] = b[h] THEN 'M' ELSE 'X' END AS op
    FROM walk WHERE v > 0 OR h > 0)),
bases AS (
  SELECT graph_id, seq_rank, pos, seq[pos + 1] AS symbol, pos AS place
  FROM (SELECT *, unnest(range(len(seq))) AS pos FROM reads WHERE seq_rank = 0)
  UNION ALL
  SELECT graph_id, seq_rank, pos, b[pos + 1], coalesce(ref, -1 - seq_rank * 1000 - pos)
  FROM walk WHERE pos IS NOT NULL),
nodes AS (
  SELECT graph_id, place, symbol,
         row_number() OVER (PARTITION BY graph_id ORDER BY min(seq_rank * 1000 + pos)) - 1 AS node_id
  FROM bases GROUP BY graph_id, place, symbol),
paths AS (SELECT b.graph_id, b.seq_rank, b.pos, n.node_id FROM bases b JOIN nodes n USING (graph_id, place, symbol)),
edges AS (
  SELECT p.graph_id, p.node_id AS src, q.node_id AS dst, 2 * count(*) AS weight, min(p.seq_rank) AS ord
  FROM paths p JOIN paths q ON p.graph_id = q.graph_id AND p.seq_rank = q.seq_rank AND q.pos = p.pos + 1
  GROUP BY 1, 2, 3)"""

# every read against every path of its star graph: one column of best costs per node, nodes
# in the order (last backbone place before it, distance from there), which all edges follow
STAR_DISTANCE = STAR + """,
anchored AS (
  SELECT *, max(CASE WHEN place >= 0 THEN place END) OVER before AS anchor,
         max(CASE WHEN place >= 0 THEN pos END) OVER before AS since
  FROM bases WINDOW before AS (PARTITION BY graph_id, seq_rank ORDER BY pos)),
keys AS (
  SELECT n.graph_id, n.node_id, n.symbol, min(coalesce(a.anchor, -1)) AS anchor,
         min(CASE WHEN a.place >= 0 THEN 0 ELSE a.pos - coalesce(a.since, -1) END) AS behind
  FROM anchored a JOIN nodes n USING (graph_id, place, symbol) GROUP BY 1, 2, 3),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY anchor, behind, node_id) - 1 AS r FROM keys),
ins AS (
  SELECT e.graph_id, e.dst AS node_id, list(k.r) AS v
  FROM edges e JOIN ranked k ON k.graph_id = e.graph_id AND k.node_id = e.src GROUP BY 1, 2),
packed AS (
  SELECT k.graph_id, count(*) AS n, list(k.symbol ORDER BY r) AS symbols, list(coalesce(i.v, []) ORDER BY r) AS ins,
         list(k.node_id NOT IN (SELECT src FROM edges e WHERE e.graph_id = k.graph_id) ORDER BY r) AS ends
  FROM ranked k LEFT JOIN ins i USING (graph_id, node_id) GROUP BY 1),
dp AS (
  SELECT graph_id, seq_rank, seq AS pattern, 0::BIGINT AS r, []::BIGINT[][] AS cols FROM reads
  UNION ALL
  SELECT graph_id, seq_rank, pattern, r + 1, cols || [list_transform(fresh, lambda f, i:
           least(f, coalesce(list_min(list_transform(fresh[: i - 1], lambda y, j: y + i - j)), f)))]
  FROM (SELECT graph_id, seq_rank, pattern, r, cols, list_transform(enter, lambda e, i: CASE WHEN i = 1 THEN e + 1 ELSE
                 least(e + 1, enter[i - 1] + CASE WHEN pattern[i - 1] = symbol THEN 0 ELSE 1 END) END) AS fresh
        FROM (SELECT d.*, p.symbols[d.r + 1] AS symbol, list_transform(range(1, len(d.pattern) + 2), lambda i:
                       coalesce(list_min(list_transform(p.ins[d.r + 1], lambda u: d.cols[u + 1][i])), i - 1)) AS enter
              FROM dp d JOIN packed p USING (graph_id) WHERE d.r < p.n)))"""
