"""A corpus from raw documents: five stages, each over all that the one before kept.

Language ID drops rejected documents; near-duplicate detection (five words, Jaccard 0.8) keeps one document of each
group; suffix-array deduplication cuts repeated passages of 100 bytes or more; decontamination cuts benchmark
passages; the last stage mixes sources to their target weights and returns a row for every copy taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.llm.common import table, written
from colophon.llm.decontaminate import decontaminated
from colophon.llm.langid import fit_language, without_rejected
from colophon.llm.mixing import mixed
from colophon.llm.neardup import near_duplicates
from colophon.llm.substrings import without_repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_rejected(docs, fit_language(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal rows of one doc_id are one document and stay."""
    gone = written(near_duplicates(docs).where("NOT kept").select("doc_id").distinct(), "gone")
    small = gone.count() <= 1_000_000
    return docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Training, hashing and random draws have no SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
