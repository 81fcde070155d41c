"""The registered queries of this subpackage: thin wrappers that derive the agreed columns from the operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import _store, contamination, dialogues, extraction, neighbours, packing, quality, secrets, substrings, tokens, urls


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_read(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.find_contamination(
        _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"), keep=["doc_id"]
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.dedup_substrings(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the document of its id: bad if of low quality or toxic."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    known = F.col("quality").isNotNull() | F.col("toxic").isNotNull()
    outcomes = _read(spark, sf_dir, "labels").select("doc_id", F.when(known, F.coalesce(bad, F.lit(False)).cast("int")))
    return urls.filter_urls(_read(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call begins with an empty cache, so that its figures hold the whole work."""
    cache = f"{_store.run_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    counted = tokens.count_tokens(_read(spark, sf_dir, "documents"), tokens.word_bpe(), cache)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op7_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.jaccard_components(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    joined = "array_join(transform({}, s -> concat_ws(':', s.kind, s.begin, s.stop)), ',')"
    base = "filter(secrets, s -> s.kind != 'random')"
    return found.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(secrets, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in ("assign", "access", "hex", "random")),
        F.sha2(F.expr(joined.format(base)), 256).alias("base_sha256"),
        F.expr(joined.format("secrets")).alias("spans"),
    )


def op9_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokens.word_bpe())


def op10_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = "array_join(transform(masks, m -> concat_ws(':', m.begin, m.stop)), ',')"
    return dialogues.rotate(_read(spark, sf_dir, "conversations")).select(
        "conv_id", "perspective", "part", "first_turn", "n_messages",
        F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"), F.expr(masks).alias("masks"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_bands": op1_quality_bands,
    "op2_decontamination": op2_decontamination,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_url_reputation": op4_url_reputation,
    "op5_main_text": op5_main_text,
    "op6_token_counts": op6_token_counts,
    "op7_jaccard_components": op7_jaccard_components,
    "op8_secret_scan": op8_secret_scan,
    "op9_best_two_fit": op9_best_two_fit,
    "op10_perspective_rotation": op10_perspective_rotation,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op2_decontamination": contamination.ORACLE,
    "op3_substring_dedup": substrings.ORACLE,
    "op7_jaccard_components": neighbours.ORACLE,
    "op4_url_reputation": urls.ORACLE,
    "op10_perspective_rotation": dialogues.ORACLE,
}
