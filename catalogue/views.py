"""Inputs of the registered queries, derived from the given tables in Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.operators.joins import spread_small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with whole texts, whose rows are worth spreading over the cores."""
    return spread_small(table(spark, sf_dir, name))


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def corpus(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Every document as one chunk with a path and a dotted symbol.

    Rows are spread over the cores where every text is worked on, not in front
    of a join that keeps a few.
    """
    docs = (texts if spread else table)(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("chunk_idx"),
        F.format_string("src/%s/%s/doc_%d.md", "source", "lang", "doc_id").alias("source_path"),
        F.lit("doc").alias("kind"),
        F.format_string("%sDoc.item_%d", F.initcap("lang"), "doc_id").alias("symbol"),
        F.lit(1).alias("start_line"),
        (newlines(F.col("text")) + 1).alias("end_line"),
        "text",
    ).withColumn(
        "chunk_id",
        tx.chunk_id(F.col("source_path"), F.col("start_line"), F.col("end_line"), F.col("kind"), F.col("symbol")),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage as a question."""
    items = table(spark, sf_dir, "benchmark")
    return items.select(F.format_string("bm_%d", "item_id").alias("qid"), F.col("text").alias("question"))


def named_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage as a question that names the symbol of a document."""
    items = table(spark, sf_dir, "benchmark")
    symbols = corpus(spark, sf_dir).select(F.col("chunk_idx").alias("item_id"), "symbol")
    return items.join(symbols, "item_id").select(
        F.format_string("bm_%d", "item_id").alias("qid"),
        F.concat(F.lit("How does "), "symbol", F.lit(" work with: "), "text").alias("question"),
    )


def corpus_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of every document that has one."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_idx"), "embedding")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_idx"))
    return vectors.join(docs, "chunk_idx", "left_semi")


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of every benchmark item that has one."""
    items = table(spark, sf_dir, "benchmark").select("item_id")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return items.join(vectors, "item_id").select(
        F.format_string("bm_%d", "item_id").alias("qid"), "embedding"
    )
