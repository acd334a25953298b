"""Registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.llm import bpe, decontaminate, divergence, fm_dedup, html_text, infill, jaccard_join, language, near_dups, pii, quality, suffix_dedup, toxicity
from cartloom.llm.tables import held_out, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary files are: the folder in TOKENIZERS_DIR, else the installed package."""
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_cascade(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    order = quality.cascade(quality.estimate(docs))
    return quality.judge(docs, order).drop("rejected_by")


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.encode(table(spark, folder, "documents"), tokenizer_path())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_pii_contexts(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.with_counts(pii.find(table(spark, folder, "documents")))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"),
                        pii.written(F.col("spans")).alias("spans"))


def op5_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_dups.classes(table(spark, folder, "documents"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    scanned = decontaminate.scan(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return decontaminate.with_verdict(scanned).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    keyed = pages.select(F.struct("page_id", "url").alias("page"), "html")
    found = html_text.main_text(keyed, html_text.learn(pages), key="page")
    # The url comes along in the key, so that rows that share an id keep their own.
    return found.select("page.page_id", "page.url", "text", "n_chars")


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    predicted = language.predict(docs, language.fit(docs))
    return predicted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_fm_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = fm_dedup.remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


def op12_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.join(table(spark, folder, "documents"))


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = infill.restore(infill.rearrange(table(spark, folder, "documents")))
    return made.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"),
                       F.length("middle").cast("long").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality_cascade, op2_bpe, op3_suffix_dedup, op4_pii_contexts, op5_order_minhash, op6_decontamination,
        op7_main_text, op8_language, op9_toxicity, op10_fm_dedup, op11_source_divergence, op12_jaccard_join, op13_fill_in_middle)
}

#: The other operators have no SQL form; tests hold them against brute force.
SQL: dict[str, str] = {
    "op1_quality_cascade": quality.SQL, "op3_suffix_dedup": suffix_dedup.SQL, "op6_decontamination": decontaminate.SQL,
    "op10_fm_dedup": fm_dedup.SQL, "op11_source_divergence": divergence.SQL, "op12_jaccard_join": jaccard_join.SQL,
    "op13_fill_in_middle": infill.SQL,
}
