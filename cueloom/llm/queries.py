"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (
    ball_tree, decontaminate, divergence, hard_negatives, line_dedup, minhash, packing, quality_rules, span_dedup,
    stream_dedup, toxicity, url_filter, warc,
)
from .registry import ORACLE, QUERIES, query, table, tokenizer_path

__all__ = ["ORACLE", "QUERIES"]

OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN items b ON a.item = b.item AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM sets UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), low AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN low ON u = doc_id
"""


@query("op10_minhash_near_dedup", OP10_SQL)
def op10(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_toxicity_ftrl")
def op7(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))
    weights = toxicity.fit(docs, labels.select("doc_id", F.col("toxic").alias("label")), ~held)
    return toxicity.score(docs, weights).select(
        "doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    )


OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
), k AS (SELECT * FROM l WHERE length(line) >= 20),
u AS (SELECT line, min((doc_id, pos)) AS first, count(*) AS n, length(line) AS len FROM k GROUP BY line),
near AS (
  SELECT DISTINCT b.line FROM u a JOIN u b ON b.len BETWEEN a.len - 1 AND a.len + 1 AND a.first < b.first
  WHERE (left(a.line, least(a.len, b.len) // 2) = left(b.line, least(a.len, b.len) // 2)
      OR right(a.line, least(a.len, b.len) - least(a.len, b.len) // 2) = right(b.line, least(a.len, b.len) - least(a.len, b.len) // 2))
    AND levenshtein(a.line, b.line) <= 1
), gone AS (
  SELECT k.doc_id, k.pos FROM k JOIN u USING (line) LEFT JOIN near USING (line)
  WHERE near.line IS NOT NULL OR (k.doc_id, k.pos) <> u.first
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '') AS text
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  CASE WHEN k.doc_id IS NULL THEN d.text ELSE k.text END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


@query("op8_line_dedup", OP8_SQL)
def op8(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), report=True)


_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}'), '[^\x20\x09-\x0D]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), masks AS (
  SELECT x.c AS m, y.c AS n, list_filter(range(1, 13), lambda p: (p - 1) % 4 = x.c OR (p - 1) % 4 = y.c) AS places
  FROM (SELECT unnest(range(4)) AS c) x JOIN (SELECT unnest(range(4)) AS c) y ON x.c < y.c
), dw AS (SELECT doc_id, p, w[p + 1:p + 12] AS x FROM (SELECT doc_id, w, unnest(range(0, len(w) - 11)) AS p FROM d)),
bw AS (SELECT DISTINCT item_id, w[p + 1:p + 12] AS y FROM (SELECT item_id, w, unnest(range(0, len(w) - 11)) AS p FROM b)),
ds AS (SELECT doc_id, p, x, m, n, list_select(x, places) AS k FROM dw CROSS JOIN masks),
bs AS (SELECT item_id, y, m, n, list_select(y, places) AS k FROM bw CROSS JOIN masks),
met AS (
  SELECT DISTINCT doc_id, item_id, p, len(list_filter(range(1, 13), lambda j: x[j] <> y[j])) AS k
  FROM ds JOIN bs USING (m, n, k)
), short AS (SELECT DISTINCT item_id, w FROM b WHERE len(w) BETWEEN 1 AND 11),
sizes AS (SELECT DISTINCT len(w) AS z FROM short),
sw AS (SELECT doc_id, p, w[p + 1:p + z] AS w FROM (SELECT doc_id, w, z, unnest(range(0, len(w) - z + 1)) AS p FROM d CROSS JOIN sizes)),
found AS (
  SELECT doc_id, item_id, p, min(k) AS k FROM met WHERE k <= 2 GROUP BY doc_id, item_id, p
  UNION ALL SELECT DISTINCT doc_id, item_id, p, 0 FROM sw JOIN short USING (w)
)
SELECT doc_id, item_id, count(*) AS n_windows, min(p) AS first_word, CAST(min(k) AS BIGINT) AS mismatches
FROM found GROUP BY doc_id, item_id
"""


@query("op2_benchmark_decontamination", OP2_SQL)
def op2(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_power_of_two_packing")
def op4(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op3_sentence_span_dedup")
def op3(spark, sf_dir):
    out = span_dedup.dedup_spans(table(spark, sf_dir, "documents")).filter("removed_spans IS NOT NULL")
    return out.select("doc_id", F.explode("removed_spans").alias("s")).select(
        "doc_id", F.col("s.first").alias("first_sentence"), F.col("s.last").alias("last_sentence"),
        F.col("s.start").alias("start_byte"), F.col("s.end").alias("end_byte"),
    )


@query("op9_quality_rules")
def op9(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    model = quality_rules.fit(docs, labels.select("doc_id", F.col("quality").alias("label")), ~held)
    return quality_rules.score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )

B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP1_SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32),
    lambda i: '{B32}'[1 + (CAST('0x' || h[1 + 5 * (i // 4):5 + 5 * (i // 4)] AS INTEGER) >> (15 - 5 * (i % 4))) % 32]), '')
    AS payload_digest FROM p
), r AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM r
"""


@query("op1_warc_revisits", OP1_SQL)
def op1(spark, sf_dir):
    return warc.deduplicate(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


RULES = (
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
)


@query("op5_url_language_ratio")
def op5(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


@query("op6_ball_tree_top_k", OP6_SQL)
def op6(spark, sf_dir):
    return ball_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP11_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(text) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) WINDOW same AS (PARTITION BY text)
"""


@query("op11_stream_exact_dedup", OP11_SQL)
def op11(spark, sf_dir):
    return stream_dedup.deduplicate(spark, f"{sf_dir.rstrip('/')}/documents.parquet").select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
cells AS (
  SELECT g.lang, g.source, k.term, CAST(coalesce(c.n, 0) AS HUGEINT) AS n
  FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT *, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p
  FROM cells
), whole AS (SELECT lang, term, sum(n) AS n FROM cells GROUP BY lang, term),
q AS (
  SELECT lang, term, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM whole
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 200
"""


@query("op12_source_divergence", OP12_SQL)
def op12(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
  AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY rank <= 3
"""


@query("op13_strassen_hard_negatives", OP13_SQL)
def op13(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)
