"""The corpus pipeline: documents through five stages of the training-data package.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
stage's docs.  All but the last stage return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nullwise.llm import stages
from nullwise.llm.common import read_table, stored

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("toxicity", stages.toxicity),
    ("minhash_dedup", stages.near_dedup),
    ("mix_sources", stages.mix_sources),
    ("pack", stages.pack),
]

#: Toxicity and quality scores cannot be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
