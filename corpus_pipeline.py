"""A training corpus from documents: rules, exact and near copies, personal data, packing. Each stage is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweft.llm import exactdedup, neardup, packing, pii, quality
from seqweft.llm.common import stash
from seqweft.llm.queries import _table, _tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or the risk-controlled rules reject go."""
    return quality.filter_quality(docs, _table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return exactdedup.exact_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, linked by a similarity of 0.8 or more, the one with the smallest id stays."""
    return neardup.near_dedup(docs, similar=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kinds; n_chars follows the text."""
    n = F.length("text").cast(dict(docs.dtypes)["n_chars"])
    return pii.redact(docs).withColumn("n_chars", n)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences."""
    return packing.pack_documents(docs, _tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express tokens and packing; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.

    Null, empty and short texts fail the base rules, so they leave with the first stage. Of copies one row stays, also
    where ids are null or repeat; a null id comes after all others. Rows without lang belong to the stratum "other".
    Null sources and lengths are carried along. An empty table gives no pieces.
    """
    docs = _table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, name)
    return docs
