"""Mix sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import n_words


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Word budgets from (source, source_size): weights repeat over the sources in code point order, null last.

    The budget of `share` times all words is dealt in proportion to the weights; no target passes `most`
    times its source's size, and what is over goes to the others by weight until none is above. With
    sources in order of cap over weight, the first k meet their caps and the rest divide what is left,
    so running sums over the table of sources (one row each) find the level in one pass: that of the first
    source under its cap. Later ones take that source for full and come out lower, so it is the highest.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    table = F.array(*map(F.lit, weights))
    ranked = sizes.withColumn("weight", F.get(table, (F.row_number().over(by_name) - 1) % len(weights)).cast("double")).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    ahead, rest, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (share * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))) / F.sum("weight").over(rest)
    leveled = ranked.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(all_rows))
    return leveled.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), "cap")).alias("target"))


def mix(docs: DataFrame, size: Column | None = None, key: Column | None = None, seed: str = "mix", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, slices: int = 4096, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Take each source's exact word budget from its documents in hash-random order.

    Every document gets a key, the MD5 of its doc_id and the seed. A source's keys are cut into `slices`
    ranges; totals of the ranges give each range its start, and a running sum inside a range gives each
    document its own, so no task ever holds a whole source. A budget of e whole epochs and a rest takes
    each document e times, and once more while the rest lasts: the last document is cut at the budget.

    Returns `keep`, source, size, source_size, target and taken (words, repeats counted). Null texts have size
    0. Null doc_ids share one key and are told apart by text; equal rows are interchangeable. A null
    source is a source of its own, after all others. An empty table gives an empty result.
    """
    rows = docs.select(*keep, "source", (n_words(F.col("text")) if size is None else size).alias("size"), (F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(seed))) if key is None else key).alias("_key"), F.xxhash64("text").alias("_tie"))
    rows = rows.withColumn("_slice", (F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * slices / F.lit(1 << 32)).cast("int"))
    slice_totals = rows.groupBy("source", "_slice").agg(F.sum("size").alias("_total"))
    starts = slice_totals.withColumn("_start", F.coalesce(F.sum("_total").over(Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    budgets = targets(slice_totals.groupBy("source").agg(F.sum("_total").alias("source_size")), weights, share, most)
    starts = starts.join(budgets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select("source", "_slice", "_start", "source_size", "target")
    inside = Window.partitionBy("source", "_slice").orderBy("_key", "_tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    starts = starts.select(F.col("source").alias("_s"), F.col("_slice").alias("_p"), "_start", "source_size", "target")
    joined = rows.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_p")))
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0))
    rest = F.floor(F.col("target") - epochs * F.col("source_size")) - F.col("_start") - F.col("_inside")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least("size", rest))
    return joined.select(*keep, "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


ORACLE = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ':mix')) AS key
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
         2.0::DOUBLE * source_size AS cap FROM sources),
leveled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own
  FROM ranked),
budgets AS (
  SELECT source, source_size, least(cap, coalesce(max(CASE WHEN own * weight <= cap THEN own END) OVER () * weight, cap)) AS target FROM leveled),
placed AS (
  SELECT doc_id, rows.source, size, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY rows.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM rows JOIN budgets ON rows.source IS NOT DISTINCT FROM budgets.source)
SELECT doc_id, size, source_size, target,
       CAST(coalesce(floor(target / nullif(source_size, 0)), 0) * size
            + greatest(0, least(size, floor(target - coalesce(floor(target / nullif(source_size, 0)), 0) * source_size) - start)) AS BIGINT) AS taken
FROM placed
"""
