"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns the documents it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossloom.llm import stages
from glossloom.llm.common import delete, new_dir, read_table, scope

STAGES = [
    ("quality", stages.quality_stage),
    ("near_dedup", stages.dedup_stage),
    ("decontamination", stages.decontamination_stage),
    ("mixing", stages.mixing_stage),
    ("sharding", stages.sharding_stage),
]
#: The classifier is fitted and the fingerprints use XXH64, which DuckDB's SQL lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table. What the stages wrote on their way, and each table once the next one is written, is deleted."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        at = new_dir(spark, name)
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(at)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(at), at
    return docs
