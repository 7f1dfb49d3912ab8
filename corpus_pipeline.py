"""Corpus preparation in four stages over ``documents``, each written as Parquet and read again.

Language identification drops what is no language; the n-gram Jaccard join keeps the smallest document
of each group of near duplicates (five-word shingles, similarity 0.8); substring deduplication cuts
passages of 50 words and more that a smaller document has; best-fit packing lays what is left into
sequences. All stages but the last return the columns of ``documents``, whatever further columns there are and
however they are called. Each stage takes empty tables, and whole texts of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.llm.common import cut
from assetloom.llm.fm_dedup import without_repeats
from assetloom.llm.language_id import in_a_language
from assetloom.llm.packing import measured, pack
from assetloom.llm.partenum import jaccard_components


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is of no language go, those with null or empty text too; repeated rows share their fate, null ids are judged by their text."""
    return in_a_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stays if it is the smallest of its component; of rows with one id all stay, and rows with null ids."""
    gone = jaccard_components(docs, n=5, p=80, q=100).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated words go, and rows that lose all of theirs; ``n_chars`` is counted anew (null for a null text).

    Of equal passages the smallest id's stays. Rows without words stay as they are.
    """
    return without_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start_word, n_words, bin_id, bin_offset). A row without words is one piece of no words with a null bin; repeated rows are packed each; equal pieces go by the lower id."""
    return pack(measured(docs)).withColumnRenamed("id", "doc_id")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packing)]

#: SQL can't express exchange-free packing or the language model; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
