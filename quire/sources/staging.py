"""Cutting the lineage of iterative operators."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder where all executors reach it."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file:///tmp/checkpoints/quire-{os.getuid()}"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write rows to a table in the folder that all executors share and read them back."""
    path = shared_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    context = df.sparkSession.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def together(tables: list[DataFrame]) -> DataFrame:
    """The union of tables that cut() gave, as one scan of all their folders."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*(t._cut_path for t in tables))
