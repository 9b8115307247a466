"""Line and paragraph dedup: normalise units, group their digests globally, keep the earliest, cut the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SPACE, small, stage

#: Least words of a unit that can be removed. 1: every unit that is not blank.
MIN_WORDS = 1
SEPARATOR = {"line": "\n", "paragraph": "\n\n"}


def normalise(unit: Column) -> Column:
    """Lower case, digits as 0, white space as single spaces, none at the ends."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(unit), SPACE, " "), r"[0-9]+", "0"))


def units(rows: DataFrame, unit: str, min_words: int = MIN_WORDS) -> DataFrame:
    """id, tie, place and digest of every unit that is not blank and long enough to count."""
    flat = rows.select("id", "tie", F.posexplode(F.split("text", SEPARATOR[unit])).alias("place", "unit"))
    flat = flat.select("id", "tie", "place", normalise(F.col("unit")).alias("form")).where(F.col("form") != "")
    if min_words > 1:
        flat = flat.where(F.size(F.split("form", " ")) >= min_words)
    return flat.select("id", "tie", "place", F.unhex(F.md5("form")).alias("digest"))


def remove_lines(docs: DataFrame, unit: str = "line", carry: tuple[str, ...] = (), min_words: int = MIN_WORDS) -> DataFrame:
    """Remove every line (or paragraph) that an earlier place of the corpus has.

    All units but blank ones count, however short; a higher `min_words` spares headings, captions and the like.
    Units are compared in normal form; places rank by (doc_id, number of the unit), null doc_ids last.
    Digests are counted before anything is joined, so units that occur once never meet; a hot unit is one
    row of the table of firsts. Returns doc_id, `carry`, n_chars, spans (start, end of removed units in code points of
    the original text, in order) and kept (the other units, joined as they were). Null texts count as
    empty. Rows that repeat a doc_id and text are one document and share its result. Other columns are
    ignored; an empty table gives an empty result.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id")
    rows = docs.select(key, F.xxhash64("text", "doc_id").alias("tie"), F.coalesce("text", F.lit("")).alias("text"), "doc_id", *carry)
    separator = SEPARATOR[unit]
    found = stage(units(rows.select("id", "tie", "text"), unit, min_words), "line-units")  # texts are normalised once
    spot = F.struct("id", "tie", "place")
    firsts = found.groupBy("digest").agg(F.min(spot).alias("first"), F.max(spot).alias("last")).where("first <> last").select("digest", "first")
    firsts = small(stage(firsts, "line-firsts"))
    gone = found.join(firsts, "digest").where(spot != F.col("first")).groupBy("id", "tie").agg(F.array_sort(F.collect_set("place")).alias("gone"))
    joined = rows.join(small(stage(gone, "line-gone")), ["id", "tie"], "left")
    parts, lost = F.split("text", separator), F.map_from_arrays("gone", F.transform("gone", lambda _: F.lit(True)))
    marked = F.transform(parts, lambda u, i: F.struct(u.alias("unit"), F.coalesce(F.element_at(lost, i), F.lit(False)).alias("lost")))
    begun = F.aggregate(marked, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")), lambda acc, u: F.struct((acc["at"] + F.char_length(u["unit"]) + len(separator)).alias("at"), F.when(u["lost"], F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.char_length(u["unit"])).alias("end"))))).otherwise(acc["spans"]).alias("spans")), lambda acc: acc["spans"])
    empty = F.array().cast("array<struct<start:int,end:int>>")
    kept = F.array_join(F.transform(F.filter(marked, lambda u: ~u["lost"]), lambda u: u["unit"]), separator)
    return joined.select("doc_id", *carry, F.char_length("text").cast("long").alias("n_chars"), F.when(F.col("gone").isNull(), empty).otherwise(begun).alias("spans"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS place, unnest(string_split(coalesce(text, ''), chr(10))) AS unit
  FROM documents),
normal AS (
  SELECT *, trim(regexp_replace(regexp_replace(lower(unit), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g')) AS form,
         CAST(sum(length(unit) + 1) OVER (PARTITION BY doc_id ORDER BY place) - length(unit) - 1 AS BIGINT) AS start FROM lines),
ranked AS (SELECT *, form <> '' AND row_number() OVER (PARTITION BY form ORDER BY doc_id, place) > 1 AS gone FROM normal)
SELECT doc_id, coalesce(string_agg(unit, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text,
       CAST(length(coalesce(string_agg(unit, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS BIGINT) AS n_chars,
       CAST(count(*) FILTER (gone) AS BIGINT) AS n_spans,
       CAST(coalesce(sum(length(unit)) FILTER (gone), 0) AS BIGINT) AS n_removed,
       coalesce(string_agg(concat(start, '-', start + length(unit)), ' ' ORDER BY place) FILTER (gone), '') AS spans
FROM ranked GROUP BY doc_id
"""
