"""Documents to packed training sequences: each stage is written as Parquet and read by the next.

toxicity: toxic documents go. exact_dedup: of equal texts one stays. near_dedup: of each class of texts
linked by an n-gram Jaccard similarity of 0.8 or more one stays. secrets: secrets in the text are
replaced by a mark. packing: the pieces of all documents in sequences of at most 4096 tokens.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm import exact_dedup, jaccard_join, packing, secrets, toxicity
from shelfspark.llm.common import documents, labels, query, stage

TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_documents(docs, toxicity.train(docs, labels(spark, sf_dir)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask_secrets(docs, secrets.train(docs, labels(spark, sf_dir)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(docs, public_tokenizers.path(TOKENIZER)))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies),
    ("secrets", mask_secrets), ("packing", pack),
]

#: Learned models and free choices of the packing have no SQL form; tests hold the stages to brute force.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir)
    for name, function in STAGES:
        rows = stage(function(spark, rows, sf_dir), name)
    return rows
