"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rankweave.llm.language_id import keep_identified
from rankweave.llm.line_dedup import remove_boilerplate
from rankweave.llm.packing import pack, token_pieces
from rankweave.llm.simhash import drop_near_copies
from rankweave.llm.suffix_dedup import drop_repeated_passages
from rankweave.session import work_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found."""
    return keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate across sites."""
    return remove_boilerplate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_copies(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without long passages that occur more than once."""
    return drop_repeated_passages(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the training sequences."""
    pieces = token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pack(pieces).withColumnRenamed("doc", "doc_id")


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash", near_copies),
    ("suffix_dedup", passages),
    ("packing", packing),
]

#: hashing, language vectors and packing are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's rows are written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        made, path = stage(spark, docs, sf_dir), work_path(spark, name)
        made.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
