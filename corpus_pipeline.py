"""Training corpus from ``documents``: quality, near-duplicates, repeated passages, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import mixing, packing, quality, simhash, substring
from tesserae.llm.common import save

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least Jaccard similarity of five-word shingles of near-duplicates.
SIMILARITY = 0.8


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of those that came in."""
    docs = docs.select(*COLUMNS)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.classify(docs, model, keep=tuple(COLUMNS)).where("predicted = 1").select(*COLUMNS)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of SIMILARITY connect: the smallest doc_id."""
    return simhash.representatives(docs.select(*COLUMNS), similarity=SIMILARITY)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur again; what has no other words goes."""
    cut = substring.dedup_substrings(docs.select(*COLUMNS), keep=("lang", "source", "n_chars"))
    cut = cut.where("n_words = 0 or n_removed < n_words")
    size = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept_text").cast("long"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", size.alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The source mix: documents left out, cut where a source's target ends, or repeated once."""
    return mixing.mixed(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", good), ("near_duplicates", unlike), ("repeated_passages", unrepeated), ("mix", mixture), ("pack", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: SQL has neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None
