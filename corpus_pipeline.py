"""A training corpus from `documents`: rules, near-duplicates, secrets, mixing, packing.

Each stage takes all rows that its predecessor kept.  All but the last return
the columns of `documents`; the last returns the pieces with their sequences.

* quality rules: documents that the policy rejects go
* near-duplicates: of each component of texts alike by 0.8 or more (Jaccard of shingles
  of five words) one document stays, that with the smallest id
* secrets: reported spans are replaced by a placeholder; `n_chars` follows where it was set
* mixing: a document stays as often as the mix takes it
* packing: pieces of at most 1024 tokens, placed in sequences

Nulls, ties and repeated rows are treated as each operator says.  Columns
beside those of `documents` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import mixing, nearcopies, packing, quality, secrets
from gleaner.llm.common import durable


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.kept(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = secrets.scan(docs.select(row.alias("__row"), F.col("text").alias("__text")), "__text")
    clean = found.withColumn("__clean", secrets.redact(F.col("__text"), F.col("__spans")))
    columns = [F.col(f"__row.`{c}`").alias(c) for c in docs.columns]
    for place, name in enumerate(docs.columns):
        if name == "text":
            columns[place] = F.col("__clean").alias("text")
        elif name == "n_chars":
            changed = F.size("__spans") > 0
            length = F.when(changed & F.col("__row.n_chars").isNotNull(), F.length("__clean")).otherwise(F.col("__row.n_chars"))
            columns[place] = length.cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return clean.select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs)
    copies = F.explode(F.array_repeat(F.lit(True), F.col("__copies").cast("int")))
    return mixed.withColumn("__copy", copies).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = packing.pack(packing.pieces(docs))
    return packed.select(
        F.col("id").alias("doc_id"),
        "piece",
        "start",
        "length",
        F.col("crc").alias("ids_crc32"),
        F.col("sequence").alias("sequence_id"),
        "offset",
    )


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Fingerprints and tokens are not expressible in SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stage's rows written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
