"""A training corpus from raw documents: toxicity, near duplicates, repeated passages, source mix, tokens.

Each stage takes what its predecessor kept, as a table of the columns of ``documents``; the last returns token digests.
All stages take empty tables, null and empty texts (which have no words: like nothing else, and taken by the mix in a source's whole epochs only), null
ids (their rows stay, each by itself), rows that share an id (one document to the near duplicates, rows of their own elsewhere),
null sources and languages, texts of any length; columns beyond those of ``documents`` are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from protospark.llm import bpe, jaccard_join, mixing, substring_dedup, toxicity
from protospark.llm.common import cut, table, without

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 stay."""
    return toxicity.score(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of Jaccard similarity 0.75 join, the one with the smallest id stays."""
    docs = docs.select(*COLUMNS)
    return without(docs, jaccard_join.jaccard_components(docs).where("doc_id <> component_id"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 20 that start earlier in the corpus go; a document of which nothing is left goes."""
    cleaned = substring_dedup.substring_dedup(docs, texts=True, carry=("lang", "source"))
    cleaned = cleaned.where("n_removed = 0 or n_removed < n_words")
    return cleaned.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix(docs, carry=("text", "lang", "source", "n_chars"))
    mixed = mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return mixed.select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document taken."""
    return bpe.encode(docs, bpe.vocabulary_path(), emit="digests")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: No SQL states the trained toxicity stage; tests/llm/test_llm.py checks the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
