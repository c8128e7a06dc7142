"""The registered queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from obsmill.llm import ann, bpe, cover_tree, html_text, ngram_join, packing, secret_scan, substring_dedup, toxicity, url_filter
from obsmill.llm.common import read
from obsmill.session import ship

#: A ranked list of words for the guess costs.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: The dealt rules: host, path prefix, verdict.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(read(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(read(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(read(spark, sf_dir, "pages"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(read(spark, sf_dir, "documents"), vocabulary=VOCABULARY).drop("n_guess")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(read(spark, sf_dir, "embeddings"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"))


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: shipped(f)
    for f in (op1_toxicity, op2_ngram_jaccard_join, op3_substring_dedup, op4_byte_bpe, op5_best_fit_packing, op6_url_filters, op7_html_extraction, op8_secret_scans, op9_embedding_near_dedup, op10_nearest_neighbours)
}

_SITES = " OR ".join(f"u.host = '{h}' OR ends_with(u.host, '.{h}')" for h, _ in url_filter.LISTED)
#: Components of the pairs of a CTE ``link(a, b)`` over the ids of a CTE ``node(id)``.
_REACH = """
edges AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT id, id AS other FROM node UNION SELECT reach.id, edges.b FROM reach JOIN edges ON reach.other = edges.a),
component AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""
SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
link AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM tokens x JOIN tokens y ON x.t = y.t AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), node AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN component ON doc_id = id""",
    "op9_embedding_near_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
link AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.label = y.label AND x.id < y.id AND list_cosine_similarity(x.e, y.e) >= 0.98),
node AS (SELECT id FROM v), {_REACH},
degree AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM component LEFT JOIN degree ON id = a""",
    "op6_url_filters": f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, row_number() OVER () AS r,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(h, p, v) AS (
  VALUES {', '.join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}
), best AS (
  SELECT u.r, arg_max(h || p, length(h || p) * 1000 + length(h)) AS rule, arg_max(v, length(h || p) * 1000 + length(h)) AS v
  FROM u JOIN rules ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p) GROUP BY u.r
)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN ({_SITES}) AND starts_with(u.path, '/') THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN best USING (r)""",
}
