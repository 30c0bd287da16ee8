"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and applies one operator.

All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fertility
from . import toxicity as toxic
from .common import read_table, stored
from .minhash import minhash_dedup
from .mixing import mixed_documents
from .repack import pack_documents

#: Words of a shingle in the near-dedup stage (the op8 query takes four by its own contract).
SHINGLE = 5
#: Ids of dropped documents (8 bytes each) up to which their table is broadcast.
GONE = 2_000_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and fertility rules keep."""
    return fertility.quality_rules(docs).where("kept").select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic, by a network trained on the labelled ones among docs."""
    scored = toxic.toxicity(docs, read_table(spark, sf_dir, "labels"), toxic.held_out_fifth)
    return scored.where(F.col("predicted") == 0).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates on five-word shingles, that with the smallest id.

    Of repeated rows (same id) one stays; rows without an id stay.
    """
    verdict = stored(minhash_dedup(docs, shingle=SHINGLE).select("doc_id", "kept").where(F.col("doc_id").isNotNull()), "verdict")
    gone = stored(verdict.where(~F.col("kept")).select("doc_id").distinct(), "gone")
    # the texts stay where they are while the ids fit a broadcast
    out = docs.join(F.broadcast(gone) if gone.count() <= GONE else gone, "doc_id", "left_anti").select(docs.columns)
    repeated = stored(verdict.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return out
    once = out.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return out.join(repeated, "doc_id", "left_anti").select(docs.columns).union(once.select(docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences; a document taken twice is packed twice."""
    return pack_documents(docs)
