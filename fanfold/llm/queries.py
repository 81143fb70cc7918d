"""The registered queries of this subpackage and the SQL beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanfold.llm import (decontamination, exact_dedup, fill_in_middle, importance, language_id, license_scan, near_dedup,
                         packing, pii, subword_lm, substring_dedup, token_counts, toxicity)
from fanfold.llm.common import in_remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(body):
        QUERIES[name] = body
        if sql is not None:
            ORACLES[name] = sql.strip()
        return body

    return keep


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file, which every executor has."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_best_fit_packing")
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@query("op2_substring_dedup", substring_dedup.ORACLE)
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(table(spark, sf_dir, "documents"))


@query("op3_decontamination", decontamination.ORACLE)
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_near_dedup", near_dedup.ORACLE)
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query("op5_subword_lm")
def op5_subword_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword_lm.score(table(spark, sf_dir, "documents"), ~in_remainder("doc_id", 5, 1),
                            tokenizer_file("piece_bpe_32k.model"))


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


@query("op8_exact_dedup", exact_dedup.ORACLE)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), in_remainder("doc_id", 4, 2)
    model = language_id.train(docs.where(~held_out))
    return language_id.predict(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, held_out = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), in_remainder("doc_id", 5, 0)
    lexicon = toxicity.train(docs, labels.where(~held_out))
    return toxicity.score(docs, lexicon).select("doc_id", held_out.alias("held_out"), "score",
                                                (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op11_license_scan", license_scan.ORACLE)
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license_scan.report(license_scan.scan(docs, license_scan.build_index(docs)))


@query("op12_importance", importance.ORACLE)
def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


@query("op13_fill_in_middle", fill_in_middle.ORACLE)
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(fill_in_middle.infill(fill_in_middle.store(table(spark, sf_dir, "documents"))))
