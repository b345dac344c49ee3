"""From raw documents to packed training sequences: five stages over all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sensorloom.llm import decontam, jaccard, lines, packing
from sensorloom.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, null and empty texts among them; the rest stay as they are, repeated rows alike."""
    judged = lines.line_quality(docs.withColumn("body", F.col("text")))
    return judged.where("kept").select("doc_id", F.col("body").alias("text"), "lang", "source", "n_chars")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source (null sources are one) go; n_chars is counted anew, null for a null text. All rows stay."""
    return lines.drop_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of similar documents one row stays, the one with the smallest id (none comes last).

    Rows are told apart by a 64-bit hash of all their columns, so rows that share an id, or have none, are compared like any
    others; rows that are equal in all columns are one. Texts without words are similar to nothing and stay.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("row"))
    found = jaccard.jaccard_components(keyed, key="row").groupBy(F.col("doc_id").alias("row")).agg(F.min("component_id").alias("component"))
    ids = keyed.groupBy("row").agg(F.first("doc_id").alias("doc_id"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    stays = ids.join(found, "row").groupBy("component").agg(best).select("best.row")
    return keyed.join(stored(stays), "row", "left_semi").dropDuplicates(["row"]).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly such passages go. Null and empty texts have none and stay."""
    clean = decontam.without_hits(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences; a null or empty text is one end token."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", best_fit_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
