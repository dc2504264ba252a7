"""The corpus pipeline: from documents to token ids.

Each stage takes what the one before kept, with the columns of documents, and is written as Parquet and read again before
the next one. The last one gives the ids of the documents that are left.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomdex.llm.common import remove, shared_folder, table
from loomdex.llm.decontamination import decontaminate
from loomdex.llm.exact_dedup import drop_exact_duplicates
from loomdex.llm.near_dedup import drop_near_duplicates
from loomdex.llm.quality import keep_good
from loomdex.llm.sentencepiece_codec import encode

MODEL = "piece_bpe_32k.model"


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects. Null and empty texts are judged as empty ones."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the largest id; null counts as empty."""
    return drop_exact_duplicates(docs)


def dissimilar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by shingles of five words and a similarity of 0.8."""
    return drop_near_duplicates(docs, width=5, percent=80)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without contaminated documents, and without the benchmark's passages in the others."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left; null and empty texts have none."""
    return encode(docs, public_tokenizers.path(MODEL))


STAGES = [
    ("quality", good_documents),
    ("exact_dedup", distinct_documents),
    ("near_dedup", dissimilar_documents),
    ("decontamination", clean_documents),
    ("sentencepiece", encoded_documents),
]

#: The classifier of the first stage is trained on the tables, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table; what each kept goes through Parquet in the shared folder.

    A stage's folder is removed once the next one's is written; the last one, which the result reads, stays. Null texts
    count as empty, rows with repeated or null ids are documents of their own, an empty table gives no rows, and columns
    beyond doc_id and text are carried along as they are, whatever their names.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        now = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(now)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(now), now
    return docs
