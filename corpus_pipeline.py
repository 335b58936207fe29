"""A pipeline from raw documents to packed training sequences."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vicinal.llm import jaccard, mixing, ordinal, packing, secrets
from vicinal.llm.common import checkpointed, table

STAGES = [
    ("quality classifier", ordinal.quality_stage),
    ("n-gram Jaccard join", jaccard.near_duplicate_stage),
    ("secret scans", secrets.redact_stage),
    ("mixing sources", mixing.mix_stage),
    ("best-two-fit packing", packing.pack_stage),
]

#: SQL can express neither the trained classifier nor the packing; tests hold operators of the stages against plain versions, not ``run`` as a whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; what each returns is written to the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    checkpointed(spark.range(1))  # sets a folder where the session has none
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
