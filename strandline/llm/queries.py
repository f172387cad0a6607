"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, html_text, language_model, licenses, mixing, neighbours, packing
from .near_dups import near_duplicates
from .substrings import remove_repeats
from .toxicity import toxicity


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule of a mixture in which every source is taken at least once and none more than twice."""
    rows, _ = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), max_repeats=2.0)
    return rows.select("doc_id", "source", "n_tokens", "epoch", "block_key", "doc_key")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), across=True, required=licenses.REQUIRED)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op7_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.digest(decontaminate.contamination(docs, benchmark))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_html_text": op2_html_text,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_token_packing": op7_token_packing,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_toxicity": op10_toxicity,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op8_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
     s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35),
     k AS (SELECT doc_id, i, array_to_string(ws[i : i + 34], ' ') AS w FROM s),
     r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY w) AS n FROM k),
     gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM r, range(0, 35) t(j) WHERE n > 1),
     word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS pos FROM d),
     kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY pos) AS x FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY 1)
SELECT d.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(x, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
""",
    "op9_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS ws FROM documents),
     b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS ws FROM benchmark),
     bi AS (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0),
     win AS (SELECT DISTINCT item, array_to_string(ws[i : i + 9], ' ') AS w, least(len(ws), 10) AS n FROM bi),
     sizes AS (SELECT DISTINCT n FROM win),
     di AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n),
     hit AS (SELECT doc_id, i, n, item FROM (SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS w FROM di) x JOIN win USING (w, n)),
     pos AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, range(0, 10) t(j) WHERE j < n GROUP BY 1),
     items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS x FROM (SELECT DISTINCT doc_id, item FROM hit) y GROUP BY 1)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
""",
}
