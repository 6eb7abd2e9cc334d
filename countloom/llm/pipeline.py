"""The corpus pipeline: five stages over documents, each written and read again.

Stages 1 to 4 return the columns of documents, whatever further columns those
have and however they are named; the last returns the pieces of the packed
sequences. A null text fails the rules, as does an empty one; of rows equal in
id and text one stays; an empty table gives no pieces; without labels only the
base test decides, and without benchmark items nothing leaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, linededup, packing, quality_rules, simhash
from .common import materialize


def tokenizer_path() -> str:
    """The public byte-level BPE vocabulary; imported here only, so that the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and no learned rule rejects."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines and repeated passages; n_chars follows the text."""
    return linededup.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 1024 tokens with the sources in proportion."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality rules", rules), ("line dedup", lines), ("near duplicates", near_duplicates), ("decontamination", decontaminate), ("packing", pack)]

#: The stages learn rules and tokenize; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
