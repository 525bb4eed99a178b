"""The queries of this subpackage and what SQL says of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.llm import fingerprints, language, licenses, mixing, near_duplicates, packing, prefix_trie, ranked_search, secrets_scan, templates, topk, toxicity, warc
from visitloom.llm.common import table

#: Queries of the top-k search: rows whose vec_id is divisible by this.
EVERY = 50


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark.read.parquet(table(sf_dir, "documents")))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(spark.read.parquet(table(sf_dir, "documents")), width=4).drop("group_id")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract(spark.read.parquet(table(sf_dir, "pages")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(spark.read.parquet(table(sf_dir, "documents")))


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    master = warc.records(spark.read.parquet(table(sf_dir, "pages")))
    return warc.audit(warc.tree(master), warc.tree(warc.worn(master)))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark.read.parquet(table(sf_dir, "documents")))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark.read.parquet(table(sf_dir, "documents")))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(table(sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where(F.col("vec_id") % EVERY == 0), k=5)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_next(spark.read.parquet(table(sf_dir, "documents")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(spark.read.parquet(table(sf_dir, "documents")), spark.read.parquet(table(sf_dir, "labels")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark.read.parquet(table(sf_dir, "conversations")))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(spark.read.parquet(table(sf_dir, "documents")), spark.read.parquet(table(sf_dir, "benchmark")))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.digest(secrets_scan.scan(spark.read.parquet(table(sf_dir, "documents"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_license_scan, op2_minhash_near_dedup, op3_html_extraction, op4_language_id, op5_warc_fixity, op6_best_fit_packing, op7_source_mix, op8_exact_top_k, op9_fingerprints, op10_toxicity, op11_prefix_trie, op12_ranked_search, op13_secret_scan)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.oracle_sql(), "op5_warc_fixity": warc.oracle_sql(), "op8_exact_top_k": topk.oracle_sql(every=EVERY), "op11_prefix_trie": prefix_trie.oracle_sql(), "op12_ranked_search": ranked_search.oracle_sql()}
