"""The registered queries of the text operators, and SQL where it can say the same."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sensorloom.llm import align, chat, decontam, forest, html, jaccard, lines, lm, mil, packing, pii, ranked
from sensorloom.llm.common import table
from sensorloom.llm.sql import ORACLES  # noqa: F401


def op1_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return chat.link_calls(*chat.calls_of_turns(table(spark, folder, "conversations")), chat.TOOLS)


def op2_site_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.drop_boilerplate(table(spark, folder, "documents")).select("doc_id", "source", "n_lines_dropped", "text")


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, folder, "documents"))


def op5_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = mil.train(docs, table(spark, folder, "labels").where(~held_out))
    return mil.predict(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_quality(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_words_left")


def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.benchmark_hits(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        decontam.item_digest().alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_pii(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.withColumn("base", base).select(
        "doc_id", *map(count, ("email", "ip", "card", "phone")),
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("pii")).alias("spans"))


def op10_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(table(spark, folder, "documents"))


def op11_ranked_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return forest.lsh_components(table(spark, folder, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align.align(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (
    op1_chat_formatting, op2_site_line_dedup, op3_best_fit_packing, op4_ngram_jaccard_join, op5_html_extraction, op6_quality_classifier, op7_quality_rules, op8_benchmark_decontamination, op9_pii, op10_lm_scoring,
    op11_ranked_lexical_search, op12_minhash_near_dedup, op13_tokenizer_alignment,
)} | {"pipeline": corpus_pipeline.run}
