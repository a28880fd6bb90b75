"""The registered queries of this subpackage: thin digests of what its operators return."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedonica.llm import (
    centroids, decontaminate, language, licences, neighbours, oracle, packing, pii, quality,
    simhash, spelling, token_counts, token_files, warc,
)
from hedonica.llm.common import table
from hedonica.session import fresh_path


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, end_id=2)
    return token_files.token_digests(spark, path).select(
        "doc_id", "start", "n_tokens", "ids_crc32"
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), end_id=1)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked, name = decontaminate.mark(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"]
    )
    found = F.col(name)
    return marked.select(
        "doc_id",
        found["n_words"].alias("n_words"),
        found["n_hit"].alias("n_hit"),
        F.size(found["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(found["items"], ","), 256).alias("items_sha256"),
        decontaminate.contaminated(found).alias("contaminated"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a crawl of all pages and their versions: what each revisit stands for, and its headers."""
    records = warc.parsed(warc.crawl_of_versions(table(spark, sf_dir, "pages"), between=5_000))
    lines = F.transform("headers", lambda h: F.concat_ws(": ", h["name"], h["value"]))
    return warc.resolved(records).select(
        "record_id", "canonical_url", "outcome", "refers_to", F.array_join(lines, "; ").alias("headers")
    )


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.held_out_predictions(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    df, name = quality.judged(docs)
    return df.select("doc_id", F.col(f"{name}.*"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "paragraph", "word", "family", F.round("probability", 6).alias("probability"),
        F.round("similarity", 6).alias("similarity"), "text",
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > token_counts.LIMIT)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.variants(table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))
    return centroids.with_inertia(found).select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


QUERIES = [
    op1_pii, op2_token_files, op3_packing, op4_simhash, op5_decontaminate, op6_warc,
    op7_language, op8_quality, op9_licences, op10_token_counts, op11_spelling,
    op12_neighbours, op13_centroids,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return oracle.SQL
