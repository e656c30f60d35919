"""The registered queries of the training-data operators, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, imatch, jaccard, langid, lexical, licenses, mining, packing, pii, quality, sharding, superkmer
from .common import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"))


def op2_adaptive_scan_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out("doc_id", 3, 1))
    net = langid.train(docs.filter("not held_out"))
    return langid.identify(docs.select("doc_id", "held_out", "text"), net).drop("text")


def op4_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", langid.held_out("doc_id", 5, 0))
    labels = table(spark, sf_dir, "labels").filter(~langid.held_out("doc_id", 5, 0))
    return quality.score(docs, quality.train(docs, labels)).select("doc_id", "held_out", "score", "predicted")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffled(table(spark, sf_dir, "documents"))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def listed(spans: str):
        return F.array_join(F.transform(f"pii.{spans}", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    counts = [F.size(F.filter("pii.base", _of(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    added = (F.size("pii.spans") - F.size("pii.base")).cast("long").alias("n_added")
    return docs.select("doc_id", *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"), added)


def op11_super_kmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = superkmer.deduplicated(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mining.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.postings(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def _of(kind: str) -> Callable:
    return lambda s: s["kind"] == kind


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_ngram_jaccard_join, op2_adaptive_scan_ann, op3_byte_cnn_language, op4_quality_scores, op5_bpe_round_trip, op6_license_scan, op7_hypergeometric_shards, op8_imatch, op9_packing, op10_skip_chain_pii, op11_super_kmer_dedup, op12_hard_negatives, op13_ranked_search)
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_license_scan": licenses.sql(), "op11_super_kmer_dedup": superkmer.sql(), "op12_hard_negatives": mining.sql(), "op13_ranked_search": lexical.sql()}
