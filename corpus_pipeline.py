"""A corpus pipeline of four stages: language, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last return the columns of
documents, those that a stage does not know included.  An empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvara.llm import layout
from sylvara.llm.language_id import identify
from sylvara.llm.ngram_join import ngram_components
from sylvara.llm.packing import pack
from sylvara.llm.queries import learns
from sylvara.llm.substring_dedup import dedup_substrings


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text fits a language that the corpus teaches.

    Null or empty text and text without letters goes.  A row with a null doc_id is judged but teaches nothing; rows
    that repeat are judged each for itself.  A null lang teaches nothing, and no lang at all accepts nothing."""
    others = [c for c in docs.columns if c != "doc_id"]
    return identify(docs, learns(), carry=others).where("accepted").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each component of linked documents.

    Rows that repeat a doc_id are one document: all of it stays or goes, and of its rows of equal text one stays, the
    least by its other columns.  Rows with a null doc_id and documents without words link with nothing and stay."""
    found = ngram_components(docs).where("doc_id IS NOT NULL").groupBy("doc_id")
    flags = layout.cut_lineage(found.agg(F.bool_or(F.col("component_id") != F.col("doc_id")).alias("gone"), F.count("*").alias("n")).where("gone OR n > 1"))
    kept = docs.join(flags.where("gone").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    again = flags.where("n > 1 AND NOT gone").select("doc_id")
    if again.isEmpty():
        return kept
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    whole = kept.join(again, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("rest"))
    single = kept.join(again, "doc_id", "left_anti").select(*docs.columns)
    return single.unionByName(whole.select("doc_id", "text", "rest.*")).select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated passages; a text that has none stays as it was.

    Null text stays null.  Rows that repeat count as several places of their words.  A text of which all words go
    stays as an empty one; n_chars follows the text."""
    others = [c for c in docs.columns if c != "doc_id"]
    out = dedup_substrings(docs, carry=others)
    cut = out.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences of 4096.

    Null and empty text is an end token alone.  Rows that repeat a doc_id, and those without one, are packed each
    for itself."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language), ("ngram_join", near_duplicates), ("substring_dedup", passages), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = layout.cut_lineage(docs)
    return docs
