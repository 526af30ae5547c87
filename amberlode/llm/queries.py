"""The registered queries of this package and the DuckDB SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amberlode.llm import ann, bpe, bpe_tree, html_main, license_scan, line_dedup, near_dedup, packing, quality, secret_scan
from amberlode.llm.common import durable, table

NEAR_DEDUP = near_dedup.Params(shingle=3, percent=85)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), NEAR_DEDUP)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = bpe.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.packed(durable(counted.select("doc_id", "n_tokens"), "counts"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op6_additive_quantisation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_texts(table(spark, sf_dir, "pages"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_digests(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"

OP1_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 OR ws IS NULL THEN []
      WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' '))) END AS sh
  FROM w
), n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s
), e AS (SELECT doc_id, unnest(sh) AS g FROM s
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)
), both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT doc_id AS d, doc_id AS c FROM documents
  UNION
  SELECT r.d, b.y FROM r JOIN both_ways b ON b.x = r.c
), c AS (SELECT d, min(c) AS component_id FROM r GROUP BY d)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c ON c.d = n.doc_id
"""

OP5_SQL = rf"""
WITH w AS (
  SELECT doc_id, source, text, coalesce(regexp_extract_all(text, {_WORDS}), []) AS ws, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), win AS (
  SELECT doc_id, text, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i:i+2])) AS g FROM w WHERE len(ws) > 3
), rep AS (SELECT doc_id, text, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, text, g) > 1
), cov AS (SELECT doc_id, text, count(DISTINCT j) AS n FROM (SELECT doc_id, text, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY ALL
), b AS (
  SELECT w.doc_id, w.source, w.text, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(ws, '')), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(coalesce(w.text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id AND cov.text = w.text
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b
), l AS (
  SELECT DISTINCT doc_id, source, text, unnest(list_filter(list_transform(ls, lambda x: lower(regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'))), lambda x: length(x) >= 20)) AS k FROM w
), lim AS (SELECT source, k, count(DISTINCT doc_id) AS n, arg_min(text, doc_id) AS holder FROM l GROUP BY ALL HAVING count(DISTINCT doc_id) > 20
), lost AS (
  SELECT l.doc_id, l.text, sum(CASE WHEN lim.k IS NOT NULL AND lim.holder <> l.text THEN length(l.k) ELSE 0 END) AS gone, sum(length(l.k)) AS total
  FROM l LEFT JOIN lim ON lim.source IS NOT DISTINCT FROM l.source AND lim.k = l.k GROUP BY ALL
)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(100 * gone > 70 * total, false) AS kept
FROM f LEFT JOIN lost ON lost.doc_id = f.doc_id AND lost.text = f.text
"""

OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, i, x, translate(regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS x FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), c AS (SELECT k, max(doc_id) AS last_doc FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), m AS (SELECT l.*, c.k IS NOT NULL AND l.doc_id < c.last_doc AS gone FROM l LEFT JOIN c ON c.k = l.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_TEMPLATES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in license_scan.TEMPLATES.items())


def _license_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


OP4_SQL = f"""
WITH t AS (SELECT license, {_license_words("body")} AS ws FROM (VALUES {_TEMPLATES}) AS x(license, body)
), ts AS (SELECT DISTINCT license, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' '))) AS g FROM t
), tn AS (SELECT license, count(*) AS n FROM ts GROUP BY license
), d AS (SELECT doc_id, {_license_words("text")} AS ws FROM documents
), ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' '))) AS g FROM d WHERE len(ws) >= 3
), m AS (SELECT doc_id, license, count(*) AS k FROM ds JOIN ts ON ts.g = ds.g GROUP BY ALL)
SELECT doc_id, m.license, n AS n_shingles, k AS n_found, round(k / n, 4) AS containment FROM m JOIN tn ON tn.license = m.license WHERE 100 * k >= 80 * n
"""

OP6_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_transform(list_zip(q.e, v.e), lambda z: (z[2] - z[1]) * (z[2] - z[1])) AS s
  FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), d AS (SELECT query_id, vec_id, sqrt(list_reduce(s, lambda a, b: a + b)) AS score FROM p)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM d
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10
"""

QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_token_counts": op3_token_counts,
    "op4_license_scan": op4_license_scan,
    "op5_quality_rules": op5_quality_rules,
    "op6_additive_quantisation_search": op6_additive_quantisation_search,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_line_dedup": op8_line_dedup,
    "op9_main_text": op9_main_text,
    "op10_secret_scan": op10_secret_scan,
    "pipeline": pipeline,
}
ORACLES = {"op1_minhash_near_dedup": OP1_SQL, "op4_license_scan": OP4_SQL, "op5_quality_rules": OP5_SQL, "op6_additive_quantisation_search": OP6_SQL, "op8_line_dedup": OP8_SQL}
