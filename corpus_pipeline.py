"""Corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common, decontaminate, mixing, near_dup, substrings, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

_left: list[tuple[SparkSession, str]] = []


def _tidy(function: Stage) -> Stage:
    """Delete the tables that the stage before staged: its result is written by now."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(_left)
        before = len(common._open)
        out = function(spark, docs, sf_dir)
        _left[:] = common._open[before:]
        return out

    return run_stage


@_tidy
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of documents still here, scores below 0.7.

    Texts without words score alike and stay. Null ids and repeated rows are scored by their texts; other columns go.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.apply(docs, model, COLUMNS).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


@_tidy
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id; repeated rows once.

    Texts without words are duplicates of nothing, but rows that repeat a doc_id and text stay once.
    """
    return near_dup.one_of_each(docs.select(*COLUMNS))


@_tidy
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages of 200 bytes or more that an earlier place has; n_chars follows the text.

    Places rank by doc_id, null ids last, and offset. A null text becomes an empty one; an unchanged row keeps its n_chars.
    """
    found = substrings.remove_repeats(docs, True, ("lang", "source", "n_chars"), as_text=True)
    changed = F.size("spans") > 0
    return found.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.when(changed, F.char_length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


@_tidy
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; those with null or empty texts hold none and stay."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), COLUMNS[1:])
    return found.where("NOT contaminated").select(*COLUMNS)


@_tidy
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document; 0 of those without words. A null source is a source."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: A trained classifier and MinHash are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir/documents.parquet."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written: list[tuple[SparkSession, str]] = []
    for name, function in STAGES:
        docs = common.stage(function(spark, docs, sf_dir), f"pipeline-{name}")
        common.release(written)
        written = [common._open[-1]]
    return docs
