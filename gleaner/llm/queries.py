"""The registered queries of this folder: thin digests of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import (
    hardnegatives,
    mixing,
    neighbours,
    oracles,
    packing,
    pivots,
    quality,
    secrets,
    sharding,
    simhash,
    spelling,
    substrings,
    suffixes,
    warc,
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("__spans")
    return found.select(
        "doc_id",
        secrets.counted(spans, "assign").alias("n_assign"),
        secrets.counted(spans, "access").alias("n_access"),
        secrets.counted(spans, "hex").alias("n_hex"),
        F.sha2(secrets.listed(spans, base_only=True), 256).alias("base_sha256"),
        secrets.listed(spans).alias("spans"),
    )


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.clusters(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.removal(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        lost.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_read(spark, sf_dir, "documents").select("doc_id", "text", *sharding.DIMENSIONS))
    return placed.select(
        F.col("__id").alias("doc_id"),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("__shard").alias("shard"),
        F.col("__slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (F.col("failed").bitwiseAND(quality.BASE) != 0).alias("base_failed"),
        quality.verdict(quality.POLICIES["v1"]).alias("kept"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.removal(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("id").alias("doc_id"), "n_words", lost.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op7_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = warc.folder(spark)
    archives = warc.write(warc.planned(_read(spark, sf_dir, "pages").select("page_id", "url", "html")), root)
    return warc.read(warc.normalise(archives, root))


def op8_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).alias("taken"),
    )


def op9_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(packing.pieces(_read(spark, sf_dir, "documents").select("doc_id", "text")))
    return packed.select(
        F.col("id").alias("doc_id"),
        "piece",
        "start",
        "length",
        F.col("crc").alias("ids_crc32"),
        F.col("sequence").alias("sequence_id"),
        "offset",
    )


def op10_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_threshold_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardnegatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pivots.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(_read(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_hilbert_shards": op4_hilbert_shards,
    "op5_quality_rules": op5_quality_rules,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_warc_normaliser": op7_warc_normaliser,
    "op8_pareto_mix": op8_pareto_mix,
    "op9_best_two_fit": op9_best_two_fit,
    "op10_learned_partitions": op10_learned_partitions,
    "op11_threshold_negatives": op11_threshold_negatives,
    "op12_pivot_search": op12_pivot_search,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES = {
    "op5_quality_rules": oracles.QUALITY,
    "op6_substring_dedup": oracles.SUBSTRINGS,
    "op7_warc_normaliser": oracles.ARCHIVES,
    "op8_pareto_mix": oracles.MIX,
    "op11_threshold_negatives": oracles.NEGATIVES,
    "op12_pivot_search": oracles.PRODUCTS,
    "op13_spelling_variants": oracles.SPELLING,
}
