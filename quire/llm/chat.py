"""Chat formatting: collapse cumulative snapshots, then render the conversations that remain.

A log often holds a conversation several times, each time some turns longer. The hash of a prefix of k turns
is the sum, place by place, of digests of (place, role, text), so it rolls from turn to turn and can be
summed in pieces. A conversation whose whole hash is also the hash of a shorter prefix of another one is a
snapshot of it; an anti-join leaves the maximal ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import stage

START, END = "<|im_start|>", "<|im_end|>"
#: Turns of one conversation that a task numbers or sums at once.
BLOCK = 4096


def _running(rows: DataFrame, sums: dict[str, Column], inclusive: bool = True) -> DataFrame:
    """Running sums of each conversation in order, block by block: totals of the blocks give each its start.

    All running sums share the blocks and the order, so rows that are dealt out for one stay where they are for the next.
    """
    totals = rows.groupBy("conv_id", "block").agg(*(F.sum(v).alias(f"_t_{k}") for k, v in sums.items()))
    ahead = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), *(F.coalesce(F.sum(f"_t_{k}").over(ahead), F.lit(0)).alias(f"_s_{k}") for k in sums))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "digest").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = rows.select("*", *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_l_{k}") for k, v in sums.items()))
    joined = local.join(starts, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("block").eqNullSafe(F.col("_b")))
    return joined.select(*rows.columns, *((F.col(f"_s_{k}") + F.col(f"_l_{k}")).alias(k) for k in sums))


def _rendered() -> Column:
    """A turn in the template; markers inside texts are broken up so that only the template's own count."""
    text = F.coalesce("text", F.lit(""))
    for marker in (START, END):
        text = F.replace(text, F.lit(marker), F.lit(marker.replace("<|", "< |")))
    return F.concat(F.lit(START), F.coalesce("role", F.lit("unknown")), F.lit("\n"), text, F.lit(END), F.lit("\n"))


def _identified(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the digest of role and text."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.withColumn("digest", F.md5(F.concat_ws("\x00", F.coalesce(F.concat(F.lit("+"), "role"), F.lit("-")), F.coalesce(F.concat(F.lit("+"), "text"), F.lit("-")))))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, turn, digest, size (characters rendered), block, place (0, 1, ...) and h0 to h3, 128 bits that identify the
    prefix up to each. No texts are carried.

    The order is turn, then role and text; nulls come first. Blocks are ranges of turn numbers; turns without a number
    come first, in blocks of their digests.
    """
    rows = _identified(turns).select("conv_id", "turn", "digest", F.char_length(_rendered()).alias("size"))
    rows = rows.withColumn("block", F.struct(F.floor(F.col("turn") / BLOCK).alias("range"), F.when(F.col("turn").isNull(), F.substring("digest", 1, 2)).alias("part")))
    rows = _running(rows, {"place": F.lit(1)}).withColumn("place", F.col("place") - 1)
    whole = F.md5(F.concat_ws(":", F.col("place"), F.col("digest")))
    return _running(rows, {f"h{k}": F.conv(F.substring(whole, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)})


def skeleton(turns: DataFrame) -> DataFrame:
    """prefix_hashes() rows of conversations that are no prefix of another.

    Of equal conversations the smallest conv_id stays. Rows with a null conv_id belong to none and are left
    out; null roles and texts equal each other only; repeated rows are turns of their own.
    """
    rows = stage(prefix_hashes(turns.where("conv_id IS NOT NULL")), "chat-prefixes")
    key = ["place", "h0", "h1", "h2", "h3"]
    last = rows.groupBy("conv_id").agg(F.max(F.struct(*key)).alias("last")).select("conv_id", "last.*")
    whole = last.groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    inner = rows.join(last.select("conv_id", F.col("place").alias("_last")), "conv_id").where("place < _last").select(*key).distinct()
    kept = whole.join(inner, key, "left_anti").select("conv_id")
    return rows.join(kept, "conv_id", "left_semi")


def _with_texts(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, digest, more) with role and text, which meet them once; equal turns share theirs."""
    texts = _identified(turns.where("conv_id IS NOT NULL")).groupBy("conv_id", "turn", "digest").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    texts = texts.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("digest").alias("_d"), "role", "text")
    return rows.join(texts, (F.col("conv_id") == F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")) & (F.col("digest") == F.col("_d")))


def maximal(turns: DataFrame) -> DataFrame:
    """The turns, with place, of conversations that are no prefix of another (see skeleton())."""
    return _with_texts(skeleton(turns), turns).select("conv_id", "turn", "role", "text", "place")


def render(turns: DataFrame) -> DataFrame:
    """One rendered piece for each turn of maximal conversations, and where it begins in the whole rendering.

    The pieces of a conversation in order of place make its text; a conversation of any length is never
    gathered in one task. Null roles render as 'unknown', null texts as nothing; an empty table gives an empty
    result, other columns are ignored. Numbers and digests find the pieces; texts are shuffled once, to meet them.
    """
    rows = _running(skeleton(turns).select("conv_id", "turn", "digest", "size", "block", "place"), {"start": F.col("size")}, inclusive=False)
    out = _with_texts(rows.select("conv_id", "turn", "digest", "place", "start"), turns)
    return out.select("conv_id", "turn", F.col("place").cast("long").alias("place"), F.col("start").cast("long").alias("start"), _rendered().alias("rendered"))


ORACLE = """
WITH placed AS (
  SELECT conv_id, turn, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn,
           md5(concat(coalesce('+' || role, '-'), chr(0), coalesce('+' || text, '-')))) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
whole AS (SELECT conv_id, list(md5(concat(coalesce('+' || role, '-'), chr(0), coalesce('+' || text, '-'))) ORDER BY place) AS turns, count(*) AS n FROM placed GROUP BY conv_id),
kept AS (
  SELECT conv_id FROM whole a WHERE NOT EXISTS (
    SELECT 1 FROM whole b WHERE b.turns[1] = a.turns[1] AND b.turns[1:a.n] = a.turns AND (b.n > a.n OR b.n = a.n AND b.conv_id < a.conv_id))),
pieces AS (
  SELECT conv_id, turn, place,
         concat('<|im_start|>', coalesce(role, 'unknown'), chr(10),
           replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>'), '<|im_end|>', chr(10)) AS rendered
  FROM placed WHERE conv_id IN (SELECT conv_id FROM kept))
SELECT conv_id, turn, place,
       CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
       rendered
FROM pieces
"""
