"""The training-data pipeline: documents to sampled subword encodings, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again, so a failure repeats one
stage only. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postloom.llm.exact_dedup import stage_exact_dedup
from postloom.llm.jaccard import stage_near_dedup
from postloom.llm.language import stage_language
from postloom.llm.mixing import stage_mixing
from postloom.llm.pieces import stage_pieces
from postloom.llm.store import saved

STAGES = [
    ("language", stage_language),
    ("exact_dedup", stage_exact_dedup),
    ("near_dedup", stage_near_dedup),
    ("mixing", stage_mixing),
    ("pieces", stage_pieces),
]

#: The first and the last stage have no SQL form; tests hold every stage against a plain model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, f"stage-{name}")
    return docs
