"""Question sets in, question sets and evaluation results out."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION_SCHEMA = (
    "qid string, question string, category string, expected_paths array<string>, "
    "expected_symbols array<string>, notes string, source_chunk_id string"
)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A question set from YAML (hand-written, read on the driver), JSON lines or Parquet."""
    if path.endswith((".yaml", ".yml")):
        import yaml

        with open(path, encoding="utf-8") as f:
            entries = yaml.safe_load(f) or []
        names = [part.split()[0] for part in QUESTION_SCHEMA.split(", ")]
        rows = [tuple(e.get("id" if n == "qid" else n) for n in names) for e in entries]
        return spark.createDataFrame(rows, QUESTION_SCHEMA)
    if path.endswith((".json", ".jsonl")):
        schema = QUESTION_SCHEMA.replace("qid string", "id string")
        return spark.read.schema(schema).json(path).withColumnRenamed("id", "qid")
    return spark.read.parquet(path)


def combine(*sets: DataFrame) -> DataFrame:
    """Several question sets as one."""
    first, *rest = sets
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def write_questions(questions: DataFrame, path: str) -> int:
    """Write a question set; YAML is for sets that people read and edit."""
    if path.endswith((".yaml", ".yml")):
        import yaml

        order = ["id", "question", "category", "expected_paths", "expected_symbols", "source_chunk_id", "notes"]
        entries = []
        for row in questions.orderBy("qid").toLocalIterator():
            entry = {**row.asDict(), "id": row["qid"]}
            entries.append({name: entry[name] for name in order if name in entry})
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            yaml.safe_dump(entries, f, sort_keys=False, width=120)
        return len(entries)
    questions.withColumnRenamed("qid", "id").write.mode("overwrite").json(path)
    return questions.count()


def run_stamp() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ")


def write_results(facts: DataFrame, summary: DataFrame, by_category: DataFrame, folder: str) -> str:
    """One run: the facts as JSON lines, and a summary file with a time stamp."""
    path = f"{folder.rstrip('/')}/run_{run_stamp()}"
    facts.write.mode("overwrite").json(f"{path}/results")
    stamp = F.lit(datetime.now(timezone.utc).isoformat())
    # A row per method and a row per method and category.
    summary.withColumn("timestamp", stamp).coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    by_category.withColumn("timestamp", stamp).coalesce(1).write.mode("overwrite").json(f"{path}/by_category")
    return path


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(f"{path}/results")


def as_json(row) -> str:
    return json.dumps(row.asDict(recursive=True), ensure_ascii=False)
