"""The corpus pipeline: toxic documents go, copies go, near copies go, sources are mixed, texts become tokens.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the
next stage's ``docs``; all but the last return the columns of ``documents``. ``sf_dir`` serves the first stage only,
which learns from the labels there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from mediasift.llm import bpe, catalog, exact_dedup, mixing, near_dedup, toxicity
from mediasift.llm.shared import shared_folder


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under 0.5."""
    return toxicity.drop_toxic(docs, catalog.toxicity_field(docs, sf_dir))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the row with the largest id."""
    return exact_dedup.drop_copies(docs, keep="largest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of texts linked by a five-word shingle similarity of 0.8 or more, the row with the smallest id."""
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target rate draws it, in a global random order."""
    return mixing.replicate(docs, temperature=0.5).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids`` of every row."""
    return bpe.round_trip(docs, catalog.tokenizer_file(), with_ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("source mixing", mix_sources),
    ("bpe", tokens),
]

# A trained field and MinHash recall have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
