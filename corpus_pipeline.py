"""The corpus pipeline: quality, language, near duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import jaccard_join, language_id, mixture, packing, quality
from tessera.llm.common import table, written

STAGES = [
    ("quality classifier", quality.stage),
    ("language ID", language_id.stage),
    ("n-gram Jaccard join", jaccard_join.stage),
    ("mixing sources to target weights", mixture.stage),
    ("best-fit packing", packing.stage),
]

#: A trained classifier, a compression model, prefix trees and packing are not SQL; tests compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "pipeline")
    return docs
