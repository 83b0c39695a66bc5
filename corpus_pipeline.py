"""From raw documents to token ids: drop low quality, near copies, repeated passages and benchmark text, then encode.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableflow.llm import bpe, decontamination, jaccard_join, quality, ship, suffix_dedup
from tableflow.llm.shared import written


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model calls good; it is fitted on labelled rows of ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, "doc_id", "text", labels, "quality")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of like ones: the smallest id. Sets of five-word shingles, similarity 0.8."""
    return jaccard_join.keep_first(docs, "doc_id", "text", size=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that occur more than once; ``n_chars`` follows the text."""
    cut = suffix_dedup.without_repeats(docs, "doc_id", "text")
    return cut.withColumn("n_chars", F.coalesce(F.char_length("text").cast("bigint"), F.col("n_chars"))).select(*docs.columns)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is in a 13-word passage of ``benchmark``."""
    return decontamination.decontaminate(docs, "text", spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and what they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(docs.select("doc_id", "text"), "text", path, public_tokenizers.PATTERN, packed=True, decoded=True, keep=["doc_id"])
    return ids.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _shipped(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality", _shipped(drop_low_quality)),
    ("near_copies", _shipped(drop_near_copies)),
    ("repeats", _shipped(cut_repeats)),
    ("benchmark", _shipped(drop_benchmark_text)),
    ("tokens", _shipped(encode)),
]

#: A fitted model and the component search are not SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
