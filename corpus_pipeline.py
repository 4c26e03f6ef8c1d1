"""Documents to training sequences: rules, line dedup, near-duplicates, passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from frameloom.llm.lines import stage_lines
from frameloom.llm.minhash import stage_near_duplicates
from frameloom.llm.packing import stage_packing
from frameloom.llm.quality import stage_quality
from frameloom.llm.storage import materialize
from frameloom.llm.substrings import stage_substrings

STAGES = [
    ("quality rules", stage_quality),
    ("line dedup", stage_lines),
    ("near-duplicates", stage_near_duplicates),
    ("substring dedup", stage_substrings),
    ("packing", stage_packing),
]

#: Packing has no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{k}")
    return docs
