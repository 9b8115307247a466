"""Shared plumbing: intermediate tables, checked broadcasts and connected components."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its counted cells (rows and entries of arrays, a few dozen bytes each) are no more than this.
BROADCAST_CELLS = 1_000_000

#: ASCII white space, the only characters that separate words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_open: list[tuple[SparkSession, str]] = []


#: Bytes of a batch that a kernel sees at once, however many rows Spark sends.
BATCH_BYTES = 4 << 20


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about BATCH_BYTES; nothing is copied."""
    for batch in batches:
        step = max(1, batch.num_rows * BATCH_BYTES // max(batch.nbytes, 1))
        for begin in range(0, batch.num_rows, step):
            yield batch.slice(begin, step)


def trimmed(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A kernel for mapInArrow that sees slices of few bytes and whose worker, which Spark keeps, gives its memory back at the end of a task."""

    @functools.wraps(kernel)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(pieces(batches))
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the session names none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file:///tmp/checkpoints/quire-{os.getuid()}"
    return found.rstrip("/")


#: Partitions of narrow rows that are written as one file, the least number of files, and rows a file where they are counted.
NARROW, LEAST_FILES, ROWS_A_FILE = 16, 8, 200_000


def stage(df: DataFrame, name: str, narrow: bool = False, rows: int | None = None) -> DataFrame:
    """Cut the lineage: write the rows to a table in the shared folder and read them back.

    Tables of ids and digests (narrow) are a fraction of the texts that they speak of and get a fraction of the files;
    where a bound of the rows is known, as many as they fill.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // ROWS_A_FILE)))
    elif narrow:
        df = df.coalesce(max(LEAST_FILES, int(spark.conf.get("spark.sql.shuffle.partitions")) // NARROW))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _open.append((spark, path))
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)  # if nothing releases it before
    return spark.read.schema(df.schema).parquet(path)


def release(paths: list[tuple[SparkSession, str]] | None = None) -> None:
    """Delete staged tables (all of them by default). Only for results that are written already."""
    for spark, path in list(_open if paths is None else paths):
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        if (spark, path) in _open:
            _open.remove((spark, path))


def cells(df: DataFrame) -> int:
    """Rows of a staged table and entries of its array columns, counted."""
    arrays = [F.coalesce(F.size(f.name), F.lit(0)) for f in df.schema if f.dataType.typeName() == "array"]
    return df.agg(F.sum(sum(arrays, F.lit(1)))).first()[0] or 0


def small(df: DataFrame) -> DataFrame:
    """Broadcast a staged table if a count proves it small; otherwise leave the join to shuffle."""
    return F.broadcast(df) if cells(df) <= BROADCAST_CELLS else df


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null or blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of undirected edges (u, v), a staged table: rows (node, root), root the smallest node.

    Alternating large-star and small-star contractions, each round written to the shared folder, so
    lineage stays short and nothing is gathered on the driver but one row of counts a round.
    """
    e = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name, rows=edges.count())
    before = None
    while True:
        size = e.count() if before is None else before[0]
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        e = stage(large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", "m")).distinct(), name, rows=size)
        after = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.countDistinct("u")).first()
        if after == before or after[0] == after[2] and not e.join(e.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        before = after
