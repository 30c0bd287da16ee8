"""Registered queries of this package: each applies one operator, with its
production parameters, to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, mixing
from .common import read_table
from .fertility import quality_rules
from .hard_negatives import SQL as HARD_NEGATIVES_SQL
from .hard_negatives import hard_negatives
from .hnsw import embedding_dedup
from .html_extract import extract_text
from .langid import held_out_quarter, language_id
from .minhash import minhash_dedup
from .repack import pack_documents
from .token_output import token_output
from .toxicity import held_out_fifth, toxicity
from .warc import warc_round_trip
from .whitening import whiten

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap


@query("op1_mix_sources", mixing.SQL)
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


@query("op2_template_removal")
def op2_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op3_tokeniser_fertility")
def op3_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality_rules(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return measured.drop("text", "lang")


@query("op4_naive_bayes_language")
def op4_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id(docs, held_out_quarter("doc_id")).select("doc_id", "held_out", "lang_pred", "score")


@query("op5_token_matrices")
def op5_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op6_warc_salvage")
def op6_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(read_table(spark, sf_dir, "pages"))


@query("op7_toxicity_network")
def op7_toxicity_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", held_out_fifth("doc_id").alias("held_out"))
    return toxicity(docs, read_table(spark, sf_dir, "labels"), held_out_fifth).select("doc_id", "held_out", "score", "predicted")


@query("op8_minhash_dedup")
def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4)


@query("op9_certified_packing")
def op9_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op10_hnsw_embeddings")
def op10_hnsw_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(read_table(spark, sf_dir, "embeddings"))


@query("op11_minhash_fingerprints", fingerprint.SQL)
def op11_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whiten(vectors).withColumn("deviation", F.col("deviation").cast("long"))


@query("op13_hard_negatives", HARD_NEGATIVES_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("id") % 100 == 0)
