"""From raw documents to packed training sequences: five stages, each on all that the one before kept.

quality rules -> exact dedup -> MinHash near-dedup -> mixing to target weights -> best-fit packing. Every stage's
result is a written table that the next one reads, so a lost executor costs one stage's tasks at most.

Every stage but the last gives the columns that it is given, whatever their names: they are carried in a struct. What each
does with odd rows is what its operator does:

- quality rules: null, empty and short texts fail the base rules; null languages and sources are groups of their own;
  very long texts are judged by the same rates; repeated rows count each and are judged alike.
- exact dedup: null and empty texts are equal; of equal texts the longest original stays, ties go to the smallest id, null
  ids last; of rows that repeat one another whole one stays.
- near dedup: the row of the least id of a class stays, null ids last; of rows with equal id and text the least by all
  columns; empty texts are equal to each other only; texts of any length are aligned whole.
- mixture: null values are cells of their own; texts without words keep a probability of one; rows with a null id are drawn
  by their text; repeated rows are decided alike.
- packing: a null or empty text is the end id alone; longer texts than a sequence are cut; repeated rows are packed each.

An empty table passes through all stages as an empty table."""

from __future__ import annotations

import functools
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm.common import written
from helixframe.llm.exact_dedup import drop_copies
from helixframe.llm.mixing import sampled
from helixframe.llm.order_minhash import drop_near_copies
from helixframe.llm.packing import pack
from helixframe.llm.quality_mcd import drop_rejected
from helixframe.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the robust outlier test keep."""
    return drop_rejected(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by calibrated probabilities."""
    return sampled(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids and places in the sequences."""
    return pack(docs, vocabulary())


def _importable(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """stage, with this folder on the path of the session's Python workers, wherever the driver was started."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parent)
        paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
        if here not in paths:
            env["PYTHONPATH"] = ":".join([here, *paths])
        return stage(spark, docs, sf_dir)

    return run_stage


_STAGES = [("quality rules", quality_rules), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mixture", mixture), ("packing", packing)]
STAGES = [(name, _importable(stage)) for name, stage in _STAGES]

#: The outlier estimates, the raking and the packing are iterative, so SQL can't express run(); tests hold its first four
#: stages against a brute-force version, and the packing against its contract.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
