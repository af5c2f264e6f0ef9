"""The corpus pipeline: rules, near duplicates, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from taskloom.llm import common, decontaminate, mixing, ngram_join, quality_rules, sharding

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("ngram_jaccard_join", ngram_join.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
    ("sharding", sharding.stage),
]

#: The join's components and the fitted rates can't be stated in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``: (doc_id, source, size, text_crc32, shard, slot)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        # the next stage reads its input more than once
        docs = common.checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
