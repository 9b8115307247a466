"""Versions: newest entries win, journals with undo and redo, stale requests, caches."""

from __future__ import annotations

import itertools
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def newest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, whole rows."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def newest_values(rows: DataFrame, keys: list[str], value: str, order: Column) -> DataFrame:
    """The value of each key that comes last in the order, by one aggregate."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def overlay(base: DataFrame, pending: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Pending values where there are any, else the base's; pending rows of new keys are added."""
    p = pending.select(*keys, F.col(value).alias("_pending"), F.lit(True).alias("_has"))
    return base.join(p, keys, "full").select(*keys, F.when(F.col("_has"), F.col("_pending")).otherwise(F.col(value)).alias(value))


def sections(rows: DataFrame, keys: list[str], num: str) -> DataFrame:
    """Runs of consecutive numbers: keys, first and count."""
    rows = rows.select(*keys, num).distinct()
    w = Window.partitionBy(*keys).orderBy(num) if keys else Window.orderBy(num)
    return rows.withColumn("_island", F.col(num) - F.row_number().over(w)).groupBy(*keys, "_island").agg(F.min(num).alias("first"), F.count("*").alias("count")).drop("_island")


def runs_of_numbers(rows: DataFrame, num: str, block: int = 1 << 16) -> DataFrame:
    """sections() without keys, for any number of rows: blocks of numbers first, then only runs that meet a block's edge."""
    local = sections(rows.withColumn("_block", F.floor(F.col(num) / block)), ["_block"], num)
    local = local.withColumn("last", F.col("first") + F.col("count") - 1)
    inner = local.where((F.pmod("first", F.lit(block)) != 0) & (F.pmod(F.col("last") + 1, F.lit(block)) != 0)).select("first", "count")
    edges = local.where((F.pmod("first", F.lit(block)) == 0) | (F.pmod(F.col("last") + 1, F.lit(block)) == 0))
    w = Window.orderBy("first")  # two rows a block at most
    edges = edges.withColumn("_new", F.when(F.col("first") == F.lag("last").over(w) + 1, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    return inner.unionByName(edges.groupBy("_run").agg(F.min("first").alias("first"), F.sum("count").alias("count")).drop("_run"))


def _by_key(rows: DataFrame, key: str, order: str, kernel: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows (key, order, more) of each key, in order, through a kernel that sees them one after the other.

    Keys are sorted inside partitions, so a task holds what the kernel remembers of one key and never its rows.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        held: list[tuple] = []
        for _, group in itertools.groupby(flat, lambda r: r[0]):
            for row in kernel(group):
                held.append(row)
                if len(held) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), target, strict=True)], schema=target)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), target, strict=True)], schema=target)

    return rows.repartition(parts, key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def replay(log: DataFrame, key: str) -> DataFrame:
    """Journals (key, seq, action commit|undo|redo) to (key, seq, alive): which commits stand at the end.

    A commit clears what could be redone; undo and redo without anything to take are ignored. A task remembers the
    numbers of one journal's commits.
    """

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        commits: list[int] = []
        done: list[int] = []
        undone: list[int] = []
        name = None
        for name, seq, action in rows:  # noqa: B007
            if action == "commit":
                commits.append(seq)
                done.append(seq)
                undone.clear()
            elif action == "undo" and done:
                undone.append(done.pop())
            elif action == "redo" and undone:
                done.append(undone.pop())
        alive = set(done)
        return ((name, seq, seq in alive) for seq in commits)

    kinds = {f.name: f.dataType.simpleString() for f in log.schema}
    return _by_key(log.select(key, F.col("seq").cast("long").alias("seq"), "action"), key, "seq", fold, f"{key} {kinds[key]}, seq long, alive boolean")


def fresh_requests(requests: DataFrame, key: str, order: list[str], generation: str) -> DataFrame:
    """Requests whose generation is the highest seen by then; others are stale."""
    w = Window.partitionBy(key).orderBy(*order)
    return requests.withColumn("stale", F.col(generation) < F.max(generation).over(w))


def fifo_cache(requests: DataFrame, key: str, slots: int = 32) -> DataFrame:
    """Replay a first-in-first-out cache: (key, seq, hit). Hits do not renew an entry's age. A task remembers the slots."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: OrderedDict = OrderedDict()
        for name, seq, item in rows:
            hit = item in held
            if not hit:
                held[item] = True
                if len(held) > slots:
                    held.popitem(last=False)
            yield name, seq, hit

    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    return _by_key(requests.select(key, F.col("seq").cast("long").alias("seq"), "item"), key, "seq", fold, f"{key} {kinds[key]}, seq long, hit boolean")
