"""The ten operators' queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import chat, decontaminate, html, lines, mixing, near_dup, quality, substrings, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(_table(spark, sf_dir, "conversations"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each text, its length, and the removed lines: how many, their length and their places in the original."""
    found = lines.remove_lines(_table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    places = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"], x["end"])), " ")
    return found.select("doc_id", F.col("kept").alias("text"), F.char_length("kept").cast("long").alias("n_chars"), F.size("spans").cast("long").alias("n_spans"), gone.alias("n_removed"), places.alias("spans"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", F.col("matches.item_id").alias("item_ids"), F.round(F.array_max("matches.similarity"), 6).alias("similarity"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(_table(spark, sf_dir, "documents"), keep_first=False)
    removed = (F.col("n_bytes") - F.octet_length("kept")).cast("long")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op1_html, op2_toxicity, op3_chat, op4_quality, op5_lines, op6_warc, op7_decontaminate, op8_near_dup, op9_substrings, op10_mixing)}
ORACLES = {"op3_chat": chat.ORACLE, "op5_lines": lines.ORACLE, "op6_warc": warc.ORACLE, "op8_near_dup": near_dup.ORACLE, "op9_substrings": substrings.ORACLE, "op10_mixing": mixing.ORACLE}
