"""The corpus pipeline: four filtering and packing stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import packing, quality, simhash, toxicity
from orrery.llm.common import read, remainder, stored

TOXIC_AT, QUALITY_AT = 0.7, 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar scores under 0.7."""
    usable = F.coalesce(remainder("__id", 3) != 1, F.lit(False))
    grammar = toxicity.fit(docs, read(spark, sf_dir, "labels"), usable)
    return toxicity.keep_clean(docs, grammar, TOXIC_AT)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention model scores 0.3 or more."""
    usable = F.coalesce(remainder("__id", 5) != 0, F.lit(False))
    model = quality.fit(docs, read(spark, sf_dir, "labels"), usable)
    return quality.keep_good(docs, model, QUALITY_AT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-copy component (SimHash, or 5-word similarity of 0.8): the one with the smallest id."""
    return simhash.keep_one(docs, similarity=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the packed sequences."""
    return packing.best_fit(docs, packing.words("text"), F.col("source"), packing.same_text("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("packing", pack),
]

#: Learned models and best-fit packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
