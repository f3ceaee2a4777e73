"""The corpus pipeline: toxic documents out, shared lines once, one document per near-duplicate group, sources mixed, packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before the next stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from prismill.llm.line_dedup import dedup_lines
from prismill.llm.mixing import apply_mix
from prismill.llm.ngram_join import near_duplicates
from prismill.llm.packing import pack
from prismill.llm.queries import TOXIC_AT
from prismill.llm.text import free_name
from prismill.llm.toxicity import fit_on_tables, score_toxicity
from prismill.session import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches TOXIC_AT go. The lexicon is learned from the labelled documents that aren't held out."""
    model = fit_on_tables(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs.columns, "score")
    return score_toxicity(docs, model).where(F.col(score) < TOXIC_AT).select(*docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the smallest id only; n_chars follows the text."""
    kept = dedup_lines(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else kept


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the smallest id stays; rows that repeat this id stay together. Rows without an id stay."""
    groups = near_duplicates(docs.select("doc_id", "text"))
    go = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(go, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return apply_mix(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 4096 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


# SQL cannot express the fitted and greedy stages.
ORACLE_SQL = None

STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_shared_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
