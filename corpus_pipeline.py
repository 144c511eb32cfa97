"""The corpus pipeline: each stage calls one training-data operator on what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's
docs. All but the last return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelforge.llm import decontaminate, packing, quality, shinglejoin, suffixdedup
from panelforge.llm.common import materialise, table
from panelforge.llm.queries import bpe_path

#: Shingles as hashes, suffix arrays and token ids are beyond SQL.
ORACLE_SQL = None
#: Passages of over 50 words that repeat are cut.
PASSAGE_WORDS = 51


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shinglejoin.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixdedup.without_repeats(docs, words=PASSAGE_WORDS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, bpe_path())


STAGES = [
    ("quality rules", drop_low_quality),
    ("near copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
