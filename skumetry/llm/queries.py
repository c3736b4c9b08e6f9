"""The registered queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skumetry.llm import (
    byte_bpe, chunk_dedup, hard_negatives, language_codes, lexical, licenses, mixing, mtree, parity_join, pii, quality, suffix_dedup, toxicity,
)
from skumetry.llm.shared import shipped, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def rank_lines(name: str = VOCABULARY) -> bytes:
    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def op1_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op2_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.extract(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda k: k == F.lit(i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)]  # noqa: B023
    both = F.concat("base", "found")
    return found.select(
        "doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(both).alias("spans"),
        F.size("found").cast("long").alias("n_found"),
    )


def op3_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", mixing.word_count(F.col("text")).alias("n_words"))
    mix = mixing.mix_sources(docs, F.col("n_words"))
    return mix.select("doc_id", mixing.domain_of(F.coalesce("source", F.lit(""))).alias("domain"), "lang", "source", "n_words", "epoch")


def op4_perplexity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality.quality_verdicts(docs).select("doc_id", *quality.STATISTICS, "base_failed", "kept", "lang", "log_perplexity")


def op5_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_texts(docs, toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = F.transform("licenses", lambda m: F.concat_ws(":", m["name"], m["begin"], m["end"]))
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(listed, ",").alias("licenses"),
        F.array_max(F.transform("licenses", lambda m: m["coverage"])).alias("best_coverage"),
    )


def op7_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.link_components(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_bytes=False)


def op9_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return mtree.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.token_digests(docs, rank_lines(), public_tokenizers.PATTERN)


def op11_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    model = language_codes.learn(docs.where(fold != 2), F.col("lang"))
    found = language_codes.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous", "bits")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = {
        "op1_chunk_dedup": op1_chunk_dedup,
        "op2_bootstrapped_pii": op2_bootstrapped_pii,
        "op3_hierarchical_mix": op3_hierarchical_mix,
        "op4_perplexity_bands": op4_perplexity_bands,
        "op5_toxicity_grammar": op5_toxicity_grammar,
        "op6_license_scan": op6_license_scan,
        "op7_parity_join": op7_parity_join,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_mtree_top_k": op9_mtree_top_k,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_language_codes": op11_language_codes,
        "op12_lexical_search": op12_lexical_search,
        "op13_hard_negatives": op13_hard_negatives,
    }
    return {name: shipped(run) for name, run in every.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_hierarchical_mix": mixing.mix_sql("SELECT * FROM documents", "doc_id, domain, lang, source, mix_tokens AS n_words, epoch"),
        "op9_mtree_top_k": mtree.ORACLE_SQL,
        "op12_lexical_search": lexical.ORACLE_SQL,
        "op13_hard_negatives": hard_negatives.ORACLE_SQL,
    }
