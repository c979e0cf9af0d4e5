"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from . import decontaminate, html_text, language, licenses, lsh_vectors, minhash, mixing, pii, tokens, toxicity
from .common import table

_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_REACH = """
reach(node, other) AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
  UNION SELECT r.node, l.b FROM reach r JOIN (SELECT a, b FROM links UNION SELECT b, a FROM links) l ON r.other = l.a)
"""

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sh AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
{_REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(m.low, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(other) AS low FROM reach GROUP BY node) m ON m.node = d.doc_id
"""

OP3 = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
{_REACH}
SELECT o.vec_id, coalesce(c.n, 0) AS n_links, least(o.vec_id, coalesce(m.low, o.vec_id)) AS component_id,
       o.vec_id = least(o.vec_id, coalesce(m.low, o.vec_id)) AS kept
FROM embeddings o LEFT JOIN (SELECT node, min(other) AS low FROM reach GROUP BY node) m ON m.node = o.vec_id
LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id) c ON c.id = o.vec_id
"""

_PATTERN = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
OP6 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '{_PATTERN}') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '{_PATTERN}') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(ws)) AS k, unnest(list_transform(range(1, len(ws) - least(10, len(ws)) + 2), lambda p: array_to_string(ws[p:p + least(10, len(ws)) - 1], ' '))) AS s FROM i WHERE len(ws) > 0),
ks AS (SELECT DISTINCT k FROM win),
pos AS (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, ks WHERE len(ws) >= k),
hit AS (SELECT DISTINCT pos.doc_id, pos.p, pos.k, win.item_id FROM pos JOIN win ON win.k = pos.k AND win.s = array_to_string(pos.ws[pos.p:pos.p + pos.k - 1], ' ')),
hw AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(hw.n, 0) AS n_hit, coalesce(hi.n, 0) AS n_items,
       sha256(coalesce(hi.ids, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


def op1_minmax_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_embedding_near_dedup(spark, sf_dir):
    return lsh_vectors.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op4_temperature_mix(spark, sf_dir):
    return mixing.report(table(spark, sf_dir, "documents"))


def op5_license_scan(spark, sf_dir):
    return licenses.report(table(spark, sf_dir, "documents"))


def op6_decontamination(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_token_counts(spark, sf_dir):
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op9_pii(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


def op10_language_id(spark, sf_dir):
    return language.report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_minmax_near_dedup, op2_toxicity, op3_embedding_near_dedup, op4_temperature_mix, op5_license_scan, op6_decontamination, op7_html_text, op8_token_counts, op9_pii, op10_language_id)}
ORACLE_SQL = {"op1_minmax_near_dedup": OP1, "op3_embedding_near_dedup": OP3, "op4_temperature_mix": mixing.ORACLE, "op6_decontamination": OP6}
