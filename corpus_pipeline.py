"""From raw documents to a training mix. Each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gradus.llm import pipeline
from gradus.llm._store import shared_dir

STAGES = [
    ("language ID", pipeline.identify_language),
    ("n-gram Jaccard join", pipeline.drop_near_copies),
    ("benchmark decontamination", pipeline.cut_benchmark),
    ("secret scans", pipeline.redact_secrets),
    ("mixing sources", pipeline.mix_sources),
]
#: A trained classifier and a forest decide: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage leaves of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return out
        path = f"{shared_dir(spark)}/stage-{number}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
