"""The registered queries of the operators here, with SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqloom.llm import dialogue, divergence, exact, fingerprints, mixing, packing, repeats, secrets, sharding, simhash, tokens, toxicity, urls
from seqloom.llm.common import read
from seqloom.session import shared_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


ASSIGN = """((?i:password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


@query(
    f"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
    found AS (
      SELECT row, 0 AS place, 'assign' AS kind, regexp_extract_all(text, '{ASSIGN}', 0) AS m,
             regexp_extract_all(text, '{ASSIGN}', 2) AS g, string_split_regex(text, '{ASSIGN}') AS p, 12 AS least FROM docs
      UNION ALL
      SELECT row, 1, 'access', regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'),
             string_split_regex(text, 'AKIA[A-Z0-9]+'), 18 FROM docs
      UNION ALL
      SELECT row, 2, 'hex', regexp_extract_all(text, '[0-9a-f]{{16,}}'), regexp_extract_all(text, '[0-9a-f]{{16,}}'),
             string_split_regex(text, '[0-9a-f]{{16,}}'), 16 FROM docs
    ), each AS (
      SELECT row, place, kind, least, m, g, p, unnest(range(1, len(m) + 1)) AS i FROM found WHERE len(m) > 0
    ), placed AS (
      SELECT row, place, kind, length(g[i]) >= least AS ok, length(m[i]) AS n,
             sum(length(p[i]) + length(m[i])) OVER (PARTITION BY row, place ORDER BY i) AS stop
      FROM each
    ), joined AS (
      SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || (stop - n) || ':' || stop, ',' ORDER BY stop - n, place) AS spans
      FROM placed WHERE ok GROUP BY row
    )
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM docs LEFT JOIN joined USING (row)
    """
)
def op1_secret_spans(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(read(spark, folder, "documents", "doc_id", "text"))
    return secrets.digest_columns(found)


@query()
def op2_without_repeats(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text")
    return repeats.without_repeats(docs, with_text=False).drop("kept_text")


@query()
def op3_toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text")
    return toxicity.toxicity(docs, read(spark, folder, "labels", "doc_id", "toxic"))


@query()
def op4_simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_groups(read(spark, folder, "documents", "doc_id", "text"))
    return groups.select("doc_id", "fingerprint", "component_id")


@query()
def op5_packed_pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text")
    return packing.pack(docs, tokens.vocabulary("word_bpe_49k.json"))


@query()
def op6_piecewise_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_chain(read(spark, folder, "documents", "doc_id", "text"))


@query(
    f"""
    WITH pages_ AS (
      SELECT page_id, row_number() OVER () AS row,
             translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {A_TO_Z}) AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
      FROM pages
    ), rules(verdict, r_host, r_path) AS (
      VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
             ('block', 'net', '/es/'), ('block', 'net', '/fr/')
    ), hits AS (
      SELECT row, r_host || r_path AS rule, verdict,
             row_number() OVER (PARTITION BY row ORDER BY length(r_host || r_path) DESC) AS n
      FROM pages_ JOIN rules
        ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
    )
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
    FROM pages_ LEFT JOIN (SELECT * FROM hits WHERE n = 1) USING (row)
    """
)
def op7_url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(read(spark, folder, "pages", "page_id", "url"))


@query(
    f"""
    WITH sizes AS (
      SELECT source, sum(length(coalesce(text, ''))) AS chars FROM documents GROUP BY source
    ), rates AS (
      SELECT source,
             CASE WHEN chars > 0
                  THEN 1.0::DOUBLE / (SELECT sum(1.0::DOUBLE) FROM sizes WHERE chars > 0)
                       * (SELECT sum(chars) FROM sizes)::DOUBLE / chars::DOUBLE
                  ELSE 1.0 END AS rate
      FROM sizes
    ), parts AS (
      SELECT source, greatest(1, ceil(rate / {mixing.LARGEST_RATE}))::INT AS draws,
             rate / greatest(1, ceil(rate / {mixing.LARGEST_RATE})) AS rate
      FROM rates
    ), cdf AS (
      SELECT source, draws, k,
             sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS at_k
      FROM parts, (SELECT unnest(range(0, 160)) AS k)
    ), tables AS (
      SELECT source, any_value(draws) AS draws, list(at_k ORDER BY k) AS cdf FROM cdf GROUP BY source
    ), keyed AS (
      SELECT d.*, t.draws, t.cdf, coalesce(doc_id::VARCHAR, '-' || md5(coalesce(text, ''))) AS key
      FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source
    ), drawn AS (
      SELECT *, list_sum([len([x FOR x IN cdf IF x <=
          ('0x' || substr(md5('{mixing.SEED}:' || j || ':' || key), 1, 13))::BIGINT / 4503599627370496.0])
          FOR j IN range(0, draws)])::BIGINT AS n
      FROM keyed
    ), copies AS (
      SELECT * EXCLUDE (cdf), unnest(range(0, n)) AS copy FROM drawn WHERE n > 0
    )
    SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy,
           md5('{mixing.SEED}/' || copy || '/' || key) AS shuffle_key
    FROM copies
    """
)
def op8_poisson_mix(spark: SparkSession, folder: str) -> DataFrame:
    """All sources to equal weight, the size of the table kept."""
    docs = read(spark, folder, "documents", "doc_id", "text", "lang", "source", "n_chars")
    return mixing.mix(docs).withColumnsRenamed({"__copy": "copy", "__shuffle": "shuffle_key"})


@query()
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Starts with a cache of its own, so that every call does the whole work."""
    cache = f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}"
    docs = read(spark, folder, "documents", "doc_id", "text")
    return tokens.token_counts(docs, cache, tokens.vocabulary("byte_bpe_50k.json"))


@query(
    f"""
    WITH normal AS (SELECT doc_id, translate(coalesce(text, ''), {A_TO_Z}) AS norm FROM documents)
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC) = 1 AS kept,
           sha256(norm) AS text_sha256
    FROM normal WINDOW same AS (PARTITION BY norm)
    """
)
def op10_exact_groups(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(read(spark, folder, "documents", "doc_id", "text"), keep="largest")


#: CRC-32 of the bytes of an ASCII string, bit by bit.
CRC32 = """(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295))"""


@query(
    f"""
    WITH RECURSIVE kinds AS (
      SELECT *, {CRC32.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind
      FROM conversations
    ), hurt AS (
      SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
             unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
      FROM kinds WHERE kind <> 0
    ), placed AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hurt
    ), again AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, left(role, 1) AS initial,
             lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
             regexp_extract(text, '(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last
      FROM placed
    ), marked AS (
      SELECT conv_id, turn, role, text, i, initial, before,
             CASE WHEN last = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
      FROM again
    ), states(state, next, letter) AS (
      VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')
    ), gaps_before(state, put, cost, here) AS (  -- insertions before a row: none, one or two
      VALUES (0, '', 0, 0), (1, '', 0, 1), (2, '', 0, 2), (3, '', 0, 3), (0, 'I', 3, 2), (1, 'I', 3, 2), (2, 'I', 3, 3), (3, 'I', 3, 2),
             (0, 'II', 6, 3), (1, 'II', 6, 3)
    ), sizes AS (
      SELECT conv_id, count(*) AS n FROM marked GROUP BY conv_id
    ), steps AS (
      SELECT conv_id, n, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit, ''::VARCHAR AS lines FROM sizes
      UNION ALL
      SELECT conv_id, n, i, state, cost, audit, lines FROM (
        SELECT s.conv_id, s.n, m.i, e.goal AS state, s.cost + g.cost + e.cost AS cost, s.audit || g.put || e.letter AS audit,
               s.lines
                 || CASE WHEN g.put = '' THEN '' ELSE (SELECT letter FROM states WHERE state = g.state) || ':' || chr(10) END
                 || CASE WHEN g.put = 'II' THEN 'assistant:' || chr(10) ELSE '' END
                 || CASE e.letter WHEN 'D' THEN '' WHEN 'K' THEN m.role || ':' || m.text || chr(10)
                                  ELSE (SELECT letter FROM states WHERE state = g.here) || ':' || m.text || chr(10) END AS lines,
               row_number() OVER (PARTITION BY s.conv_id, e.goal ORDER BY s.cost + g.cost + e.cost, s.audit || g.put || e.letter) AS place
        FROM steps s
        JOIN marked m ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.i = s.i + 1
        JOIN gaps_before g ON g.state = s.state
        JOIN (
          SELECT st.state, f.fault, f.initial, o.letter, o.goal, o.cost
          FROM states st, (SELECT DISTINCT fault, initial FROM marked) f,
               (VALUES ('D', 4), ('K', 0), ('R', 3)) AS c(letter, base),
               LATERAL (SELECT c.letter AS letter,
                               CASE WHEN c.letter = 'D' THEN st.state WHEN c.letter = 'K' AND f.initial = 's' THEN 1 ELSE st.next END AS goal,
                               c.base + CASE WHEN c.letter <> 'D' AND f.fault = 'truncated' THEN 3 ELSE 0 END AS cost) o
          WHERE c.letter = 'D' OR (f.fault NOT IN ('blank', 'duplicate') AND (c.letter = 'R'
                OR (f.initial = 's' AND st.state = 0) OR f.initial = left((SELECT letter FROM states x WHERE x.state = st.state), 1)))
        ) e ON e.state = g.here AND e.fault = m.fault AND e.initial = m.initial
      ) WHERE place = 1
    ), ended AS (
      SELECT s.conv_id, s.cost + g.cost AS cost, s.audit || g.put AS audit,
             s.lines || CASE g.put WHEN 'I' THEN 'assistant:' || chr(10) WHEN 'II' THEN 'user:' || chr(10) || 'assistant:' || chr(10) ELSE '' END AS lines,
             row_number() OVER (PARTITION BY s.conv_id ORDER BY s.cost + g.cost, s.audit || g.put) AS place
      FROM steps s JOIN (VALUES (0, '', 0), (3, '', 0), (2, 'I', 3), (1, 'II', 6)) AS g(state, put, cost) ON g.state = s.state
      WHERE s.i = s.n
    ), facts AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (i > 1 AND (before || initial) NOT IN ('su', 'ua', 'au')) AS illegal
      FROM marked GROUP BY conv_id
    )
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
           coalesce(audit, '') AS audit, sha256(coalesce(left(lines, -1), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c
    LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN (SELECT * FROM ended WHERE place = 1) e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
    """
)
def op11_repaired_dialogues(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.repaired_damage(read(spark, folder, "conversations", "conv_id", "turn", "role", "text"))


@query()
def op12_equal_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.placed(read(spark, folder, "documents", "doc_id", "text"))


@query(
    f"""
    WITH docs AS (
      SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
    ), words AS (
      SELECT row, lang, source, unnest(regexp_extract_all(translate(text, {A_TO_Z}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
    ), terms AS (
      SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= {divergence.LEAST_DOCUMENTS}
    ), counts AS (
      SELECT lang, source, term, count(*) AS n FROM words JOIN terms USING (lang, term) GROUP BY lang, source, term
    ), sources AS (
      SELECT DISTINCT lang, source FROM docs
    ), sums AS (
      SELECT lang, v, coalesce(n, 0) AS whole FROM (SELECT lang, count(*) AS v FROM terms GROUP BY lang) LEFT JOIN
             (SELECT lang, sum(n) AS n FROM counts GROUP BY lang) USING (lang)
    ), totals AS (
      SELECT s.lang, s.source, coalesce(sum(n), 0) AS total FROM sources s LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source GROUP BY ALL
    ), shares AS (
      SELECT s.lang, s.source, t.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.total + 5 * v)::HUGEINT AS p
      FROM totals s JOIN terms t ON t.lang = s.lang JOIN sums ON sums.lang = s.lang
      LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = t.term
    ), whole AS (
      SELECT c.lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)::HUGEINT) // (any_value(whole) + 5 * any_value(v))::HUGEINT AS q
      FROM counts c JOIN sums ON sums.lang = c.lang GROUP BY c.lang, term
    ), priced AS (
      SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    ), rows_ AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
      FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN priced p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q
    ), ranked AS (
      SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INT AS rank FROM rows_
    )
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP}
    """
)
def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(read(spark, folder, "documents", "text", "lang", "source"))
