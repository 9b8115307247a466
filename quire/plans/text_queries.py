"""Text and search queries on the driver's document tables; documents stand for pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.fold import fold
from quire.operators import text as T
from quire.operators.geometry import bounding
from quire.plans.catalog import query, table

SQL_FOLD = "translate(strip_accents(text), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Characters of every document with the layout of synthetic_glyphs().
SQL_GLYPHS = """lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS piece FROM documents),
glyphs AS (
  SELECT doc_id, line, generate_subscripts(string_split(piece, ''), 1) - 1 AS col, unnest(string_split(piece, '')) AS uni FROM lines WHERE piece <> ''),
placed AS (SELECT doc_id, line * 16777216::BIGINT + col AS seq, uni, 72 + 7.2::DOUBLE * col AS x, 720.0::DOUBLE - 14.0::DOUBLE * line AS y FROM glyphs)"""
SQL_CHARS = SQL_GLYPHS + """,
broken AS (SELECT *, coalesce(abs(y - lag(y) OVER w) > 6, FALSE) AS far FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
chars AS (SELECT *, row_number() OVER w - 1 + sum(far::INT) OVER w AS pos FROM broken WINDOW w AS (PARTITION BY doc_id ORDER BY seq))"""
SQL_STARTS = f"""folded AS (SELECT doc_id, {SQL_FOLD} AS f FROM documents),
pieces AS (SELECT doc_id, generate_subscripts(string_split(f, 'tion'), 1) AS k, unnest(string_split(f, 'tion')) AS piece, len(string_split(f, 'tion')) AS n FROM folded),
starts AS (SELECT doc_id, CAST(sum(length(piece) + 4) OVER (PARTITION BY doc_id ORDER BY k) - 4 AS INT) AS pos, k, n FROM pieces)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang")


@query("fold_text", f"SELECT doc_id, {SQL_FOLD} AS folded FROM documents")
def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", fold(F.col("text")).alias("folded"))


@query("search_pages", f"SELECT doc_id, lang FROM documents WHERE contains({SQL_FOLD}, 'etre')")
def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a phrase in any case and with or without accents."""
    return T.pages_containing(_documents(spark, sf_dir), "Être").select("doc_id", "lang")


@query("match_offsets", f"WITH {SQL_STARTS} SELECT doc_id, pos FROM starts WHERE k < n")
def match_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.match_starts(_documents(spark, sf_dir), "TION", ["doc_id"])


@query("reconstruct_lines", f"""WITH {SQL_CHARS}
SELECT doc_id, string_agg(CASE WHEN far THEN chr(10) || uni ELSE uni END, '' ORDER BY seq) AS text FROM broken GROUP BY doc_id""")
def reconstruct_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines from the places of glyphs; a page is a row that holds its runs."""
    return T.synthetic_runs(_documents(spark, sf_dir)).select("doc_id", T.text_of_runs(F.col("runs")).alias("text"))


@query("glyph_row_lines", f"""WITH {SQL_CHARS}
SELECT doc_id, string_agg(CASE WHEN far THEN chr(10) || uni ELSE uni END, '' ORDER BY seq) AS text FROM broken GROUP BY doc_id""")
def glyph_row_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines from a row a glyph."""
    return T.page_text(T.synthetic_glyphs(_documents(spark, sf_dir)), ["doc_id"])


@query("page_chars", f"""WITH {SQL_CHARS}
SELECT doc_id, CAST(max(pos) + 1 AS BIGINT) AS n_chars, CAST(sum(far::INT) AS BIGINT) AS n_breaks, round(max(x + 7.2::DOUBLE), 3) AS right_edge FROM chars GROUP BY doc_id""")
def page_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.chars(T.synthetic_glyphs(_documents(spark, sf_dir)), ["doc_id"])
    return rows.groupBy("doc_id").agg((F.max("pos") + 1).cast("long").alias("n_chars"), F.count_if(F.col("x0").isNull()).alias("n_breaks"), F.round(F.max("x1"), 3).alias("right_edge"))


SQL_MATCH_BOXES = f"""WITH {SQL_CHARS},
found AS (SELECT doc_id, pos, seq, x, y, lead(uni, 1) OVER w AS u1, lead(uni, 2) OVER w AS u2, lead(uni, 3) OVER w AS u3, lead(far, 1) OVER w AS f1, lead(far, 2) OVER w AS f2, lead(far, 3) OVER w AS f3,
  lead(x, 3) OVER w AS x3, uni FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY seq))
SELECT doc_id, CAST(pos AS BIGINT) AS pos, round(x, 3) AS x0, round(y, 3) AS y0, round(x3 + 7.2::DOUBLE, 3) AS x1, round(y + 9.6::DOUBLE, 3) AS y1 FROM found
WHERE lower(uni) = 't' AND lower(u1) = 'i' AND lower(u2) = 'o' AND lower(u3) = 'n' AND NOT f1 AND NOT f2 AND NOT f3"""


@query("match_boxes", SQL_MATCH_BOXES)
def match_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of all matches, found in each page's own row."""
    found = T.boxes_of_matches(T.synthetic_runs(_documents(spark, sf_dir)), "tion", ["doc_id"])
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), *(F.round(c, 3).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query("glyph_row_boxes", SQL_MATCH_BOXES)
def glyph_row_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same boxes from a row a glyph; pages are dealt out before they become glyphs."""
    glyphs = T.synthetic_glyphs(T.dealt(_documents(spark, sf_dir), ["doc_id"]))
    found = T.boxes_in_glyphs(glyphs, "tion", ["doc_id"], together=True)
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), *(F.round(c, 3).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query("range_boxes", f"""WITH {SQL_CHARS}
SELECT doc_id, min(x) AS x0, min(y) AS y0, max(x + 7.2::DOUBLE) AS x1, max(y + 9.6::DOUBLE) AS y1 FROM chars WHERE pos >= doc_id % 40 AND pos < doc_id % 40 + 25 GROUP BY doc_id""".replace("SELECT doc_id, min(x) AS x0, min(y) AS y0, max(x + 7.2::DOUBLE) AS x1, max(y + 9.6::DOUBLE) AS y1", "SELECT doc_id, round(min(x), 3) AS x0, round(min(y), 3) AS y0, round(max(x + 7.2::DOUBLE), 3) AS x1, round(max(y + 9.6::DOUBLE), 3) AS y1"))
def range_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around a selected range of characters of each page."""
    rows = T.chars(T.synthetic_glyphs(_documents(spark, sf_dir)), ["doc_id"])
    found = bounding(T.boxes_in_range(rows, F.col("doc_id") % 40, F.col("doc_id") % 40 + 25), ["doc_id"])
    return found.select("doc_id", *(F.round(c, 3).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query("line_ranges", """WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord, unnest(string_split(text, chr(10))) AS piece FROM documents)
SELECT doc_id, CAST(ord AS INT) AS ord, CAST(sum(length(piece) + 1) OVER w - length(piece) - 1 AS INT) AS start, CAST(sum(length(piece) + 1) OVER w - 1 AS INT) AS "end"
FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY ord)""")
def line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.line_ranges(_documents(spark, sf_dir), ["doc_id"])


@query("word_ranges", r"""WITH runs AS (
  SELECT doc_id, generate_subscripts(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'), 1) AS ord, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')) AS piece FROM documents),
placed AS (SELECT doc_id, piece, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY ord) AS INT) AS stop FROM runs)
SELECT doc_id, CAST(stop - length(piece) AS INT) AS start, stop AS "end", piece AS word FROM placed WHERE regexp_matches(piece, '^[\p{L}\p{N}_]')""")
def word_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.word_ranges(_documents(spark, sf_dir), ["doc_id"])


@query("hit_test", f"""WITH {SQL_CHARS},
measured AS (SELECT doc_id, pos, CASE WHEN 72 + 7.2::DOUBLE * (doc_id % 90) + 3 BETWEEN x AND x + 7.2::DOUBLE AND 720 - 7.0::DOUBLE * (doc_id % 40) BETWEEN y AND y + 9.6::DOUBLE THEN -1.0
  ELSE pow(x + 3.6::DOUBLE - (72 + 7.2::DOUBLE * (doc_id % 90) + 3), 2) + pow(y + 4.8::DOUBLE - (720 - 7.0::DOUBLE * (doc_id % 40)), 2) END AS d FROM chars)
SELECT doc_id, CAST(pos AS BIGINT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(d, 6), pos) AS n FROM measured) WHERE n = 1""")
def hit_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.chars(T.synthetic_glyphs(_documents(spark, sf_dir)), ["doc_id"])
    x, y = 72 + 7.2 * (F.col("doc_id") % 90) + 3, 720 - 7.0 * (F.col("doc_id") % 40)
    return T.hit(rows, ["doc_id"], x, y).select("doc_id", F.col("pos").cast("long").alias("pos"))


@query("selection_text", """SELECT doc_id, CASE WHEN doc_id % 50 + 30 <= length(text) THEN substr(text, CAST(doc_id % 50 + 1 AS BIGINT), 30) ELSE '' END AS selected FROM documents""")
def selection_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("doc_id") % 50).cast("int")
    return _documents(spark, sf_dir).select("doc_id", T.text_in_range(F.col("text"), start, start + 30).alias("selected"))


@query("export_text", "SELECT conv_id, string_agg(coalesce(text, ''), concat(chr(12), chr(10)) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def export_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.export_text(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")


@query("next_match", """WITH hits AS (SELECT conv_id, turn FROM conversations WHERE contains(translate(strip_accents(text), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'tion'))
SELECT conv_id, turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), min(turn) OVER (PARTITION BY conv_id)) AS next FROM hits""")
def next_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return T.next_match(T.pages_containing(pages, "tion").select("conv_id", "turn"), "conv_id", "turn")
