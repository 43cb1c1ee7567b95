"""The operators as registered queries over whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_mixing, op2_substrings, op3_pieces, op4_fingerprints, op5_token_files, op6_sharding, op7_lines, op8_minhash, op9_covertree, op10_quality
from . import op11_urls, op12_filters, op13_negatives
from .common import documents

Query = Callable[[SparkSession, str], DataFrame]


def _op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_mixing.mixed(documents(spark, sf_dir), weights=(5, 2, 1), share=1.5, cap=2)


def _op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_substrings.without_repeats(documents(spark, sf_dir), window=50)


def _op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_pieces.checksums(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def _op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_fingerprints.edited_fingerprints(documents(spark, sf_dir))


def _op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = op5_token_files.written_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return op5_token_files.read_checksums(files)


def _op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_sharding.balanced(documents(spark, sf_dir), shards=40)


def _op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op7_lines.repeated_lines(documents(spark, sf_dir), equal=1, edits=4)
    return found.select("doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"))


def _op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_minhash.near_duplicates(documents(spark, sf_dir), width=4, percent=80)


def _op9_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_covertree.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.93)


def _op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_quality.scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: (verdict, host, path) of the url filter.
RULES: list[op11_urls.Rule] = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def _op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_urls.judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


def _op12_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_filters.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Query] = {
    "op1_mixing": _op1_mixing,
    "op2_substrings": _op2_substrings,
    "op3_pieces": _op3_pieces,
    "op4_fingerprints": _op4_fingerprints,
    "op5_token_files": _op5_token_files,
    "op6_sharding": _op6_sharding,
    "op7_lines": _op7_lines,
    "op8_minhash": _op8_minhash,
    "op9_covertree": _op9_covertree,
    "op10_quality": _op10_quality,
    "op11_urls": _op11_urls,
    "op12_filters": _op12_filters,
    "op13_negatives": _op13_negatives,
}

WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op9_covertree": """
WITH RECURSIVE links AS (
  SELECT a.vec_id AS u, b.vec_id AS v
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.93
), reach AS (
  SELECT vec_id AS u, vec_id AS v FROM embeddings
  UNION
  SELECT reach.u, links.v FROM reach JOIN links ON links.u = reach.v
), roots AS (
  SELECT u AS vec_id, min(v) AS component_id FROM reach GROUP BY u
), counts AS (
  SELECT u AS vec_id, count(*) AS n FROM links GROUP BY u
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM roots LEFT JOIN counts USING (vec_id)
""",
    "op2_substrings": f"""
WITH words AS (
  SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i+49], ' ') AS k FROM starts
), firsts AS (
  SELECT k, min(doc_id) AS first_id FROM windows GROUP BY k
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos
  FROM windows JOIN firsts USING (k) WHERE doc_id > first_id
), places AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM words
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n
  FROM places ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
""",
    "op8_minhash": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s
  FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM items a JOIN items b ON a.item = b.item AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM documents
  UNION
  SELECT reach.u, links.v FROM reach JOIN links ON links.u = reach.v
), roots AS (
  SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN roots USING (doc_id)
""",
    "op12_filters": f"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS w FROM documents
), firsts AS (
  SELECT coalesce(text, '') AS t, min(doc_id) AS first_id FROM documents GROUP BY ALL
), known AS (
  SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id
), marked AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN words.doc_id > first_id THEN 'E' ELSE '' END AS fails
  FROM words JOIN firsts USING (t) LEFT JOIN known USING (doc_id)
), cells AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM marked GROUP BY part, fails
), letters(f) AS (
  VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS f, filter_order[:step-1] AS earlier
  FROM orders, range(1, 6) AS r(step)
), applied AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN len(fails) = len(translate(fails, earlier || f, '')) THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(fails, f) AND len(fails) = len(translate(fails, earlier, '')) THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(fails, f) AND len(fails) > len(translate(fails, earlier, '')) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(fails, f) AND len(fails) = len(translate(fails, earlier, '')) THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(fails, f) AND len(fails) = len(translate(fails, earlier, '')) THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM applied
""",
    "op13_negatives": """
WITH rows_in AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM rows_in a JOIN rows_in b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 3
""",
}
