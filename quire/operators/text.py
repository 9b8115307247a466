"""Text of pages: lines from glyphs, search with match boxes, hit tests, selection. All in built-in functions but boxes_in_glyphs()."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.fold import Folds, fold, fold_text

#: Vertical steps over this share of the taller glyph start a new line.
LINE_BREAK = 0.5
WORD_CLASS = r"\p{IsAlphabetic}\p{IsDigit}\p{Nl}\p{No}_"


def page_text(glyphs: DataFrame, keys: list[str], by_height: str = "d") -> DataFrame:
    """keys and text from glyphs (keys, seq, uni, y, and the height column): glyphs in order, a line break before each that
    stands more than half the taller height away from the one before. Glyphs without a character are skipped."""
    w = Window.partitionBy(*keys).orderBy("seq")
    height = F.greatest(F.abs(by_height), F.lit(1.0))
    rows = glyphs.where("uni IS NOT NULL").withColumn("_h", height)
    far = F.abs(F.col("y") - F.lag("y").over(w)) > F.greatest("_h", F.lag("_h").over(w)) * LINE_BREAK
    rows = rows.withColumn("_piece", F.when(far, F.concat(F.lit("\n"), "uni")).otherwise(F.col("uni")))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "_piece"))), lambda x: x["_piece"]), "").alias("text"))


def chars(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, ch and box of every character of page_text(); inserted line breaks have no box."""
    w = Window.partitionBy(*keys).orderBy("seq")
    rows = glyphs.where("uni IS NOT NULL").withColumn("_h", F.greatest(F.abs("d"), F.lit(1.0)))
    far = F.abs(F.col("y") - F.lag("y").over(w)) > F.greatest("_h", F.lag("_h").over(w)) * LINE_BREAK
    box = F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 0.6 * F.col("_h")).alias("x1"), (F.col("y") + 0.8 * F.col("_h")).alias("y1"))
    empty = F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>")
    own = F.transform(F.filter(F.split("uni", ""), lambda c: c != ""), lambda c: F.struct(c.alias("ch"), box.alias("box")))
    rows = rows.withColumn("_far", F.coalesce(far, F.lit(False)))
    rows = rows.select(*keys, "seq", F.posexplode(F.when(F.col("_far"), F.concat(F.array(F.struct(F.lit("\n").alias("ch"), empty.alias("box"))), own)).otherwise(own)).alias("_k", "_c"))
    order = Window.partitionBy(*keys).orderBy("seq", "_k")
    return rows.select(*keys, (F.row_number().over(order) - 1).alias("pos"), "_c.ch", "_c.box.*")


def pages_containing(pages: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Pages whose folded text contains the folded query; none for an empty query."""
    return pages.where(F.contains(fold(F.col(text)), F.lit(fold_text(query))) if query else F.lit(False))


def match_starts(pages: DataFrame, query: str, keys: list[str], text: str = "text") -> DataFrame:
    """keys and pos (code points, from 0) of every occurrence of the query, overlapping ones included.

    The folded text is cut in front of every occurrence in one pass; running lengths of the pieces are the
    positions. (A substring at every position would read a text as often as it has characters.)
    """
    needle = fold_text(query)
    if not needle:
        return pages.select(*keys, F.lit(0).alias("pos")).limit(0)
    pieces = F.split("_f", f"(?={_quoted(needle)})")
    rows = pages.select(*keys, fold(F.col(text)).alias("_f")).where(F.contains("_f", F.lit(needle)))
    rows = rows.select(*keys, F.startswith("_f", F.lit(needle)).alias("_at_start"), F.posexplode(pieces).alias("_k", "_piece"))
    before = Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("pos", F.coalesce(F.sum(F.char_length("_piece")).over(before), F.lit(0)).cast("int"))
    return rows.where("_k > 0 OR _at_start").select(*keys, "pos")


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or ord(c) > 127 else f"\\x{{{ord(c):x}}}" for c in text)


def match_boxes(char_rows: DataFrame, starts: DataFrame, length: int, keys: list[str]) -> DataFrame:
    """keys, pos and the box around the characters of each match; matches of line breaks alone have none and go.

    char_rows holds every character of its pages, as chars() gives them. Both sides meet once a page, so the join has
    the partitioning that the characters have already, and no character is shuffled for it.
    """
    pages = char_rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "x0", "y0", "x1", "y1"))).alias("_chars"))
    places = starts.groupBy(*keys).agg(F.collect_list("pos").alias("_starts"))

    def box(start: Column) -> Column:
        part = F.slice("_chars", start + 1, length)
        return F.struct(start.alias("pos"), *(least(part[c]).alias(c) for least, c in ((F.array_min, "x0"), (F.array_min, "y0"), (F.array_max, "x1"), (F.array_max, "y1"))))

    found = pages.join(places, keys).select(*keys, F.inline(F.transform("_starts", box)))
    return found.where("x0 IS NOT NULL")


RUN = "struct<text:string,xs:array<double>,y:double,d:double>"


def _height(run: Column) -> Column:
    return F.greatest(F.abs(run["d"]), F.lit(1.0))


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate a column once for a function that refers to it many times."""
    return F.get(F.transform(F.array(value), use), 0)


def _broken(runs: Column, k: Column) -> Column:
    """Whether a line break stands in front of run k: it lies more than half the taller height away from the one before."""
    one, before = F.get(runs, k), F.get(runs, k - 1)
    return (k > 0) & (F.abs(one["y"] - before["y"]) > F.greatest(_height(one), _height(before)) * LINE_BREAK)


def _joined(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r, k: F.when(_broken(runs, k), F.concat(F.lit("\n"), r["text"])).otherwise(r["text"])), "")


def text_of_runs(runs: Column) -> Column:
    """page_text() of a page that holds its glyphs as an array of runs (RUN) in order: a run has one character for each of
    its xs, all on one height. Nothing is shuffled or sorted, and a page is a row."""
    return _bind(runs, _joined)


def _running(sizes: Column) -> Column:
    """Sums of all entries before each one."""
    empty = F.array().cast("array<int>")
    return F.aggregate(sizes, F.struct(F.lit(0).alias("at"), empty.alias("all")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["all"], a["at"]).alias("all")), lambda a: a["all"])


def _match_box(runs: Column, begins: Column, start: Column, length: int) -> Column:
    """The box of the characters start to start + length, of runs that begin at those positions."""
    end = start + length
    low = F.greatest(F.size(F.filter(begins, lambda b: b <= start)) - 1, F.lit(0))
    high = F.greatest(F.size(F.filter(begins, lambda b: b < end)) - 1, F.lit(0))

    def part(run: Column, begin: Column) -> Column:
        a = F.greatest(start - begin, F.lit(0))
        xs = F.slice(run["xs"], a + 1, F.greatest(F.least(end - begin, F.size(run["xs"])) - a, F.lit(0)))
        return _bind(xs, lambda x: F.struct(F.array_min(x).alias("x0"), F.when(F.size(x) > 0, run["y"]).alias("y0"), (F.array_max(x) + 0.6 * _height(run)).alias("x1"), F.when(F.size(x) > 0, run["y"] + 0.8 * _height(run)).alias("y1")))

    def whole(parts: Column) -> Column:
        return F.struct(start.alias("pos"), *(least(parts[c]).alias(c) for least, c in ((F.array_min, "x0"), (F.array_min, "y0"), (F.array_max, "x1"), (F.array_max, "y1"))))

    return _bind(low, lambda at: _bind(F.zip_with(F.slice(runs, at + 1, high - at + 1), F.slice(begins, at + 1, high - at + 1), part), whole))


def _places(text: Column, needle: str) -> Column:
    """Where a folded text has the needle."""
    every = _running(F.transform(F.split(text, f"(?={_quoted(needle)})"), F.char_length))
    return F.when(F.startswith(text, F.lit(needle)), every).when(F.contains(text, F.lit(needle)), F.slice(every, 2, F.size(every))).otherwise(F.array().cast("array<int>"))


#: Glyphs that one task makes, about.
GLYPHS_A_TASK = 500_000


def dealt(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Pages dealt out by their keys before they become glyph rows: what has to have a page's glyphs in one task shuffles none."""
    glyphs = pages.agg(F.coalesce(F.sum(F.char_length(text)), F.lit(0))).first()[0]
    least = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pages.repartition(max(least, -(-glyphs // GLYPHS_A_TASK)), *keys)


def boxes_in_glyphs(glyphs: DataFrame, query: str, keys: list[str], together: bool = False) -> DataFrame:
    """keys, pos and box of every occurrence of a query in glyph rows (as chars() takes them): what match_starts() and
    match_boxes() say of page_text() and chars(). Rows go from Spark to a kernel once, in any order, and are neither
    sorted nor gathered there. together: every page's glyphs lie in one partition already (see dealt())."""
    needle = fold_text(query)
    columns = [*keys, "seq", "uni", "x", "y", "d"]
    if not needle:
        return glyphs.select(*keys, F.lit(0).alias("pos"), *(F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1"))).limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            yield from _boxes_in(pa.Table.from_batches(held), needle, keys)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in glyphs.select(*keys).schema)
    rows = glyphs.select(*columns).where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, "uni"]))
    return (rows if together else rows.repartition(*keys)).mapInArrow(run, f"{kinds}, pos int, x0 double, y0 double, x1 double, y1 double")


def _page_starts(glyphs: pa.Table, keys: list[str]) -> np.ndarray:
    first = np.zeros(glyphs.num_rows, bool)
    first[0] = True
    for key in keys:
        column = glyphs[key].combine_chunks()
        first[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return first


def _boxes_in(glyphs: pa.Table, needle: str, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The matches of whole pages: lines break as in page_text(), and characters are numbered through all pages."""
    first, seq = _page_starts(glyphs, keys), glyphs["seq"].to_numpy()
    if not ((seq[1:] > seq[:-1]) | first[1:]).all() or glyphs.group_by(keys).aggregate([]).num_rows != first.sum():
        glyphs = glyphs.sort_by([(c, "ascending") for c in (*keys, "seq")])
        first = _page_starts(glyphs, keys)
    x, y, d = (glyphs[c].to_numpy() for c in ("x", "y", "d"))
    height = np.fmax(np.abs(d), 1.0)
    far = np.zeros(len(x), bool)
    far[1:] = ~first[1:] & (np.abs(y[1:] - y[:-1]) > np.fmax(height[1:], height[:-1]) * LINE_BREAK)
    uni = glyphs["uni"].combine_chunks()
    pieces = pc.if_else(pa.array(far), pc.binary_join_element_wise("\n", uni, ""), uni)
    sizes = pc.utf8_length(uni).to_numpy() + far
    begin = np.cumsum(sizes) - sizes
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces), "")[0].as_py().translate(Folds())
    page = np.flatnonzero(first)
    limits = [*begin[page].tolist(), len(text)]
    hits = []
    for low, high in zip(limits, limits[1:], strict=False):
        at = text.find(needle, low, high)
        while at >= 0:
            hits.append(at)
            at = text.find(needle, at + 1, high)
    if not hits:
        return
    hits = np.array(hits)
    own = np.searchsorted(limits[:-1], hits, "right") - 1
    places = hits[:, None] + np.arange(len(needle))
    glyph = np.searchsorted(begin, places, "right") - 1
    broken = far[glyph] & (places == begin[glyph])  # an inserted line break has no box
    x0, y0, x1, y1 = (np.where(broken, np.nan, v[glyph]) for v in (x, y, x + 0.6 * height, y + 0.8 * height))
    boxes = [least.reduce(v, axis=1) for least, v in ((np.fmin, x0), (np.fmin, y0), (np.fmax, x1), (np.fmax, y1))]
    out = glyphs.select(keys).take(pa.array(page[own]))
    for name, values in zip(("pos", "x0", "y0", "x1", "y1"), ((hits - np.array(limits)[own]).astype(np.int32), *boxes), strict=True):
        out = out.append_column(name, pa.array(values))
    yield from out.filter(pa.array(~np.isnan(boxes[0]))).to_batches()


def boxes_of_matches(pages: DataFrame, query: str, keys: list[str], runs: str = "runs") -> DataFrame:
    """keys, pos and box of every occurrence of a query in pages that hold runs; overlapping ones count, matches of line
    breaks alone have no box and go. What match_starts() and match_boxes() say of the same glyphs, page by page."""
    needle = fold_text(query)
    length = len(needle)
    if not needle:
        return pages.select(*keys, F.lit(0).alias("pos"), *(F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1"))).limit(0)

    def begins(own: Column) -> Column:
        broken = F.transform(own, lambda _, k: _broken(own, k).cast("int"))
        return _bind(broken, lambda b: F.zip_with(_running(F.zip_with(own, b, lambda r, n: F.size(r["xs"]) + n)), b, lambda n, m: n + m))

    def found(own: Column) -> Column:
        return _bind(F.struct(begins(own).alias("begins"), _places(fold(_joined(own)), needle).alias("places")), lambda z: F.transform(z["places"], lambda start: _match_box(own, z["begins"], start, length)))

    return pages.select(*keys, F.inline(_bind(F.col(runs), found))).where("x0 IS NOT NULL")


def synthetic_runs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The glyphs of synthetic_glyphs() as an array of runs, a line each."""
    xs = lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.char_length(p) - 1, F.lit(0))), lambda k: 72 + 7.2 * k)
    lines = F.transform(F.split("text", "\n"), lambda p, k: F.struct(p.alias("text"), xs(p).alias("xs"), (F.lit(720.0) - 14.0 * k).alias("y"), F.lit(12.0).alias("d")))
    return docs.where("text IS NOT NULL").select(key, F.filter(lines, lambda r: r["text"] != "").alias("runs")).where(F.size("runs") > 0)


def hit(char_rows: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    """keys and the position of the first character whose box holds the point, else of the nearest centre."""
    inside = x.between(F.col("x0"), F.col("x1")) & y.between(F.col("y0"), F.col("y1"))
    distance = F.pow((F.col("x0") + F.col("x1")) / 2 - x, 2) + F.pow((F.col("y0") + F.col("y1")) / 2 - y, 2)
    rank = F.struct((~inside).alias("out"), F.when(inside, 0.0).otherwise(distance).alias("distance"), "pos")
    return char_rows.where("x0 IS NOT NULL").groupBy(*keys).agg(F.min_by("pos", rank).alias("pos"))


def text_in_range(text: Column, begin: Column, end: Column) -> Column:
    """Characters begin to end (not included); empty if the range lies outside."""
    valid = (begin >= 0) & (begin <= end) & (end <= F.char_length(text))
    return F.when(valid, F.substring(text, begin + 1, end - begin)).otherwise(F.lit(""))


def boxes_in_range(char_rows: DataFrame, begin: Column, end: Column) -> DataFrame:
    return char_rows.where((F.col("pos") >= begin) & (F.col("pos") < end) & F.col("x0").isNotNull())


def _pieces(pages: DataFrame, keys: list[str], pieces: Column, between: int) -> DataFrame:
    rows = pages.select(*keys, F.posexplode(pieces).alias("ord", "piece"))
    before = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("piece") + between).over(before), F.lit(0)).cast("int")
    return rows.withColumn("start", start).withColumn("end", start + F.char_length("piece"))


def line_ranges(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ord, start and end of every line; ends exclude the line break."""
    return _pieces(pages, keys, F.split("text", "\n"), 1).select(*keys, "ord", "start", "end")


def word_ranges(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end and word of every maximal run of letters, digits and _."""
    runs = F.regexp_extract_all("text", F.lit(f"([{WORD_CLASS}]+|[^{WORD_CLASS}]+)"), F.lit(1))
    return _pieces(pages, keys, runs, 0).where(F.col("piece").rlike(f"^[{WORD_CLASS}]")).select(*keys, "start", "end", F.col("piece").alias("word"))


def line_at(pages: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """The line that holds a position, which is clamped to the text."""
    return line_ranges(pages, keys).join(pages.select(*keys, F.greatest(F.lit(0), F.least(at, F.char_length("text"))).alias("_at")), keys).where("_at BETWEEN start AND end").drop("_at", "ord")


def word_at(pages: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """The word that holds a position; one character if it is none of a word; nothing behind the end."""
    where = pages.select(*keys, at.alias("_at"), F.char_length("text").alias("_n"))
    found = word_ranges(pages, keys).join(where, keys).where("_at >= start AND _at < end").select(*keys, "start", "end")
    rest = where.join(found, keys, "left_anti").select(*keys, F.col("_at").alias("start"), F.when(F.col("_at") < F.col("_n"), F.col("_at") + 1).otherwise(F.col("_at")).alias("end"))
    return found.unionByName(rest)


def export_text(pages: DataFrame, key: str, order: str, separator: str = "\f\n") -> DataFrame:
    """One text a document: its pages in order."""
    return pages.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), separator).alias("text"))


def next_match(pages_with_matches: DataFrame, key: str, order: str) -> DataFrame:
    """The next page with a match, from the last back to the first."""
    w = Window.partitionBy(key)
    return pages_with_matches.withColumn("next", F.coalesce(F.lead(order).over(w.orderBy(order)), F.min(order).over(w)))


def synthetic_glyphs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """A glyph row for each character but line breaks: x = 72 + 7.2 column, y = 720 - 14 line, 12 high."""
    lines = docs.select(key, F.posexplode(F.split("text", "\n")).alias("line", "piece")).where("piece <> ''")  # which splits into one empty character
    glyphs = lines.select(key, "line", F.posexplode(F.split("piece", "")).alias("col", "uni"))
    return glyphs.select(key, (F.col("line").cast("long") * (1 << 24) + F.col("col")).alias("seq"), "uni", (72 + 7.2 * F.col("col")).alias("x"), (F.lit(720.0) - 14.0 * F.col("line")).alias("y"), F.lit(12.0).alias("d"))
