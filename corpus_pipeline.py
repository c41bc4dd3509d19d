"""From raw documents to token ids, in five stages; each takes all that the one before kept."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm import bpe, linededup, mixing, partenum, queries
from tesserine.llm.common import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; rows that repeat a key stay or go together."""
    found = queries.identify_documents(docs).groupBy("doc_id").agg(F.max("kept").alias("_kept")).filter("_kept").select(F.col("doc_id").alias("_id"))
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that occur earlier; those of which nothing is left go. n_chars follows the text."""
    cut = linededup.dedup_lines(docs)
    left = (F.col("n_removed") == 0) | (F.btrim("text", F.lit(linededup.SPACE)) != "")
    return cut.filter(left).withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by 80 % of five-word shingles: the one with the smallest id.
    Rows with a null key link with nothing and stay."""
    first = partenum.near_groups(docs, num=80, den=100, width=5).filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_id")).distinct()
    kept = docs.join(first, F.col("doc_id") == F.col("_id"), "left_semi")
    return kept.unionByName(docs.filter(F.col("doc_id").isNull())).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents up to the mixture's budgets, each at most once."""
    return mixing.mix(docs, queries.mix_levels(), queries.MIX_WEIGHTS, share=0.8, epochs=1).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each whole text."""
    ids = bpe.encode(docs.select("doc_id", "text"), bpe.read_spec(queries.vocabulary()), to="ids")
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: The stages hash, sign and encode in ways that SQL has not.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over the documents of sf_dir, each result written to the shared folder and read again."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    scratch, last = Scratch(spark, "pipeline"), None
    for _, stage in STAGES:
        docs, path = scratch.write(stage(spark, docs, sf_dir))
        if last:
            scratch.drop(last)
        last = path
    return docs
