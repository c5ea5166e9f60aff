"""The corpus pipeline: each stage reads what its predecessor wrote."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamframe.llm import decontaminate, exact_dedup, near_dedup, packing, toxicity
from beamframe.llm.common import documents, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: No SQL expresses a trained model or token ids; tests compare run() with brute force.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a key of id and text, ordered as ids are, null ids last."""
    digest = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    return docs.select(*COLUMNS, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("text").isNull().alias("no_text"), digest.alias("digest")).alias("row_key"))


def _kept(docs: DataFrame, verdict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that ``verdict`` keeps; one of rows equal in id and text."""
    keyed = _keyed(docs)
    kept = verdict(keyed.select(F.col("row_key").alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("row_key")).distinct()
    return keyed.join(kept, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field predicts to be toxic go."""
    verdict = toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=[c for c in COLUMNS if c != "doc_id"])
    return verdict.where("predicted = 0").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays."""
    return _kept(docs, exact_dedup.exact_dedup)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the smallest id stays."""
    return _kept(docs, near_dedup.near_dedup)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; a document with nothing but them goes."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), cut=True, carry=["lang", "source", "n_chars"])
    left = found.where("not contaminated or n_hit < n_words")
    return left.select("doc_id", "text", "lang", "source", F.when(F.col("contaminated"), F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, packed into sequences of 1024."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", cut_benchmark),
    ("packing", pack_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = f"{scratch(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
