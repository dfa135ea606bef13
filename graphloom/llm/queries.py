"""Registered queries of the operators for training data, one per operator."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontam, mixing, pii, quality, ranked, runs, secrets, simhash, substring, tokens, topk, toxicity, warc
from graphloom.llm.oracles import ORACLES


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_docs(spark, sf_dir)).drop("kept")


def op4_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 50, as a query."""
    docs = _docs(spark, sf_dir)
    asked = docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return topk.search(docs, asked, 10)


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymize(_docs(spark, sf_dir), "demonstration key")
    return found.select("doc_id", "text", *[F.col("pii")[k].alias(f"n_{k}") for k in pii.KINDS])


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("secrets")
    of = lambda no: F.filter(spans, lambda s: s["kind_no"] == no)
    base = F.filter(spans, lambda s: s["kind_no"] < 3)
    return secrets.find_secrets(_docs(spark, sf_dir), pieces=True).select(
        "doc_id",
        *[F.size(of(no)).cast("long").alias(f"n_{kind}") for no, kind in enumerate(secrets.KINDS)],
        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"),
        secrets.spans_text(spans).alias("spans"),
    )


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return ranked.search(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.facts(_docs(spark, sf_dir))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (
        op1_token_counts, op2_decontamination, op3_substring_dedup, op4_bm25_topk, op5_pii_pseudonyms, op6_warc_archive, op7_toxicity, op8_secret_scan,
        op9_simhash_dedup, op10_source_mixing, op11_ranked_search, op12_periodic_runs, op13_quality_rules,
    )
    return {f.__name__: f for f in each} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return ORACLES
