"""The queries and SQL of this subpackage, which __spark_entry__.py adds to its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op2_ann
from .base import prepared
from .bpe import op7_bpe
from .decontaminate import op1_decontaminate
from .licenses import op4_licenses
from .lm import op8_lm_score, op8_lm_score_trigrams
from .ngram_join import op10_ngram_join
from .quality import op9_quality
from .secrets import op3_secrets
from .shards import op6_shards
from .toxicity import op5_toxicity

OPERATORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_ann": op2_ann,
    "op3_secrets": op3_secrets,
    "op4_licenses": op4_licenses,
    "op5_toxicity": op5_toxicity,
    "op6_shards": op6_shards,
    "op7_bpe": op7_bpe,
    "op8_lm_score": op8_lm_score,
    "op9_quality": op9_quality,
    "op10_ngram_join": op10_ngram_join,
}
QUERIES = {name: (lambda spark, sf_dir, run=run: run(prepared(spark), sf_dir)) for name, run in OPERATORS.items()}
#: Registered beside the ten: op8 with a longer context, which has no SQL.
MORE = {"op8_lm_score_trigrams": lambda spark, sf_dir: op8_lm_score_trigrams(prepared(spark), sf_dir)}

#: DuckDB: A-Z lowered, words as the operator takes them, windows as joined words.
OP1_SQL = r"""
WITH w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
iw AS MATERIALIZED (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i+n-1], ' ') AS win
  FROM (SELECT item_id, ws, least(8, len(ws)) AS n, unnest(range(1, len(ws) - least(8, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i+n-1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
hits AS MATERIALIZED (SELECT dw.doc_id, dw.i, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::varchar AS item FROM hits) GROUP BY doc_id)
SELECT w.doc_id, len(w.ws)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM w LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)
"""

#: Pieces between matches give their starts; overlong pieces don't arise, as each pattern is matched from the left.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
rules(kind, o, pat, least) AS (VALUES
  ('assign', 0, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+', 0),
  ('access', 1, 'AKIA[A-Z0-9]+', 20),
  ('hex', 2, '[0-9a-f]+', 24)),
m AS (SELECT doc_id, r, kind, o, least, regexp_extract_all(t, pat) AS ms, string_split_regex(t, pat) AS ps FROM d, rules WHERE kind <> 'access' OR contains(t, 'AKIA')),
x AS (SELECT doc_id, r, kind, o, least, unnest(ms) AS s, unnest(list_transform(range(1, len(ms) + 1), lambda k: list_sum(list_transform(ps[1:k], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[1:k-1], lambda q: length(q))), 0)))::bigint AS a FROM m WHERE len(ms) > 0),
f AS (SELECT *, a + length(s) AS e FROM x WHERE CASE WHEN kind = 'assign' THEN length(regexp_replace(s, '^(?:[A-Za-z_]+)["'']?\x20*[:=]\x20*["'']?', '')) >= 6 ELSE length(s) >= least END),
g AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, o) AS base FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::bigint AS n_assign, coalesce(n_access, 0)::bigint AS n_access, coalesce(n_hex, 0)::bigint AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(base, '') AS spans
FROM d LEFT JOIN g USING (r)
"""

#: Pairs that share a shingle are counted exactly; components by the smallest id along links.
OP10_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i+4], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 75 * (p.n + q.n - i)),
twoway AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, r) AS (SELECT DISTINCT x, x FROM twoway UNION SELECT b.y, reach.r FROM reach JOIN twoway b ON b.x = reach.doc_id),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

#: Bigram scores with a document's own counts taken off.
OP8_SQL = r"""
WITH w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS MATERIALIZED (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, unnest(list_concat([NULL], ws[1:len(ws)-1])) AS h FROM w WHERE len(ws) > 0),
c1 AS MATERIALIZED (SELECT w, count(*) AS c FROM t GROUP BY w), c2 AS MATERIALIZED (SELECT h, w, count(*) AS c FROM t WHERE h IS NOT NULL GROUP BY h, w),
d1 AS MATERIALIZED (SELECT doc_id, w, count(*) AS c FROM t GROUP BY doc_id, w), d2 AS MATERIALIZED (SELECT doc_id, h, w, count(*) AS c FROM t WHERE h IS NOT NULL GROUP BY doc_id, h, w),
x AS (
  SELECT t.doc_id, t.n, t.h, c1.c - d1.c AS cw, coalesce(c2.c - d2.c, 0) AS chw, ch.c - dh.c AS chist, (SELECT count(*) FROM t) - t.n AS rest
  FROM t JOIN c1 ON c1.w = t.w JOIN d1 ON d1.doc_id = t.doc_id AND d1.w = t.w
  LEFT JOIN c2 ON c2.h = t.h AND c2.w = t.w LEFT JOIN d2 ON d2.doc_id = t.doc_id AND d2.h = t.h AND d2.w = t.w
  LEFT JOIN c1 ch ON ch.w = t.h LEFT JOIN d1 dh ON dh.doc_id = t.doc_id AND dh.w = t.h),
s AS (SELECT doc_id, n, sum(CASE WHEN chw > 0 THEN ln(chw / chist) ELSE ln(greatest(cw, 0.5) / greatest(rest, 1)) + CASE WHEN h IS NULL THEN 0 ELSE ln(0.4) END END) AS score FROM x GROUP BY doc_id, n)
SELECT w.doc_id, len(w.ws)::bigint AS n_words, round(score / n, 6) AS mean_log_score FROM w LEFT JOIN s USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op8_lm_score": OP8_SQL,
    "op10_ngram_join": OP10_SQL,
    "op3_secrets": OP3_SQL,
    "op1_decontaminate": OP1_SQL,
}
