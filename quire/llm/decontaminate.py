"""Benchmark decontamination with DataFrame functions only: SimHash of item-sized windows.

1. Items and documents become hashes of five-word shingles (an item of fewer words is one shingle). Windows of the
   size of an item start where a document's shingle meets one of an item of that size: moving a window on over a
   shingle that no item has loses nothing, so one of the best windows starts there, or ends with the text.
2. Running counts of such meetings along a text say how many a window holds. No more can be shared with an item, so
   windows with fewer than the similarity asks for are done with; what is left are near copies and little else.
3. A window's fingerprint has a bit for each of 63 places, the majority over its shingles, repeats counted.
   Windows of equal content are looked at once, however many documents carry them.
4. Fingerprints are cut into RADIUS + 1 blocks, so two within RADIUS bits agree on a whole block at least;
   an equi-join on size, block and value finds them all. A similarity of 0.75 puts 11 bits apart in the
   mean, with a standard deviation of 3, and RADIUS is four of those above.
5. Candidates are verified by the exact weighted similarity of their shingles, the weights being counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import small, stage, words

SHINGLE, PERCENT = 5, 75
RADIUS, BITS = 23, 63
#: Fixed layout: a long holds three counts of 21 bits, so an item may have two million words.
LANE, LANES = 21, 3
MASKS = []
for _k in range(RADIUS + 1):
    _width = BITS // (RADIUS + 1) + (_k < BITS % (RADIUS + 1))
    MASKS.append(((1 << _width) - 1) << (MASKS[-1].bit_length() if MASKS else 0))


def _bind(value: Column, use) -> Column:
    """Evaluate a column once for a function that refers to it many times."""
    return F.get(F.transform(F.array(value), use), 0)


def shingles(text: Column, width: int) -> Column:
    """Hashes of all runs of `width` lower-case words, in order; empty if there are fewer words."""

    def run(w: Column) -> Column:
        return F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))).otherwise(F.array().cast("array<bigint>"))

    return _bind(words(F.lower(text)), run)


def _lane(hashes: Column, k: int) -> Column:
    mask = sum(1 << (LANE * lane) for lane in range(LANES))
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda total, h: total + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(mask)))


def with_fingerprint(rows: DataFrame, hashes: str) -> DataFrame:
    """Add fp, the SimHash of an array of hashes."""
    rows = rows.select("*", *(_lane(F.col(hashes), k).alias(f"_lane{k}") for k in range(LANE)))
    bits = [F.when(2 * F.shiftrightunsigned(f"_lane{k}", LANE * lane).bitwiseAND(F.lit((1 << LANE) - 1)) > F.size(hashes), F.lit(1 << (k + LANE * lane))).otherwise(F.lit(0).cast("long")) for k in range(LANE) for lane in range(LANES)]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return rows.withColumn("fp", total).drop(*(f"_lane{k}" for k in range(LANE)))


def _blocks(rows: DataFrame) -> DataFrame:
    """One row for each block of the fingerprint: its number and its bits."""
    parts = F.array(*(F.struct(F.lit(k).alias("block"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for k, m in enumerate(MASKS)))
    return rows.select("*", F.explode(parts).alias("_b")).select("*", "_b.block", "_b.part").drop("_b")


def shared(a: Column, b: Column) -> Column:
    """Shingles that two arrays share, each as often as in the array that has fewer of it."""
    common = F.array_intersect(a, b)
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    counted = F.aggregate(common, F.lit(0), lambda n, x: n + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    return F.when(plain, F.size(common)).otherwise(counted)


def likely_starts(hits: DataFrame, k: int) -> DataFrame:
    """(id, tie, size, start) of the windows that hold enough hits to be similar to an item of their size.

    hits (id, tie, size, n, p): the place p of a text of n shingles has one of an item of that size. A window's hits
    are what has been counted up to its end less what had been before its start.
    """
    room = F.greatest(F.lit(0), F.col("n") + (k - 1) - F.col("size"))  # the last start
    starts = hits.select("id", "tie", "size", "n", F.least("p", room).alias("start")).distinct()
    wide = F.col("size") - (k - 1)
    marks = hits.select("id", "tie", "size", "n", F.col("p").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("start"))
    marks = marks.union(starts.select("id", "tie", "size", "n", F.col("start").alias("at"), F.lit(0).alias("kind"), "start"))
    marks = marks.union(starts.select("id", "tie", "size", "n", (F.col("start") + wide - 1).alias("at"), F.lit(2).alias("kind"), "start"))
    order = Window.partitionBy("id", "tie", "size").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    counted = marks.withColumn("seen", F.sum((F.col("kind") == 1).cast("int")).over(order)).where("start IS NOT NULL")
    held = counted.groupBy("id", "tie", "size", "start").agg(F.max("n").alias("n"), (F.max("seen") - F.min("seen")).alias("held"))
    both = wide + F.least(wide, F.col("n"))
    return held.where((100 + PERCENT) * F.col("held") >= PERCENT * both).select("id", "tie", "size", "start")


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(id, tie, item_id, start, size, similarity): the best window of every document for every item it holds.

    docs (id, tie, text), items (item_id, text); start and size count words of the text.
    """
    sized = items.where("item_id IS NOT NULL").select("item_id", "text", F.size(words(F.lower("text"))).alias("size")).where("size > 0")
    sized = stage(sized.withColumn("width", F.least(F.lit(SHINGLE), "size")), "leak-items")
    widths = sorted(r["width"] for r in sized.select("width").distinct().collect())  # at most SHINGLE values
    if not widths:
        return docs.select("id", "tie", F.lit(None).cast("long").alias("item_id"), F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit(0.0).alias("similarity")).limit(0)
    by_width = [sized.where(F.col("width") == k).withColumn("items", shingles(F.col("text"), k)) for k in widths]
    listed = by_width[0]
    for more in by_width[1:]:
        listed = listed.union(more)
    listed = stage(with_fingerprint(listed.drop("text"), "items"), "leak-prints")
    windows = None
    for k in widths:
        places = listed.where(F.col("width") == k).select("size", F.explode("items").alias("h")).distinct()
        places = small(stage(places, "leak-places"))
        found = docs.select("id", "tie", shingles(F.col("text"), k).alias("hs")).select("id", "tie", F.size("hs").alias("n"), F.posexplode("hs").alias("p", "h"))
        hits = stage(found.join(places, "h").select("id", "tie", "size", "n", "p").distinct(), "leak-hits")
        chosen = likely_starts(hits, k).groupBy("id", "tie").agg(F.collect_list(F.struct("start", "size")).alias("windows"))
        chosen = small(stage(chosen, "leak-windows"))
        cut = docs.select("id", "tie", "text").join(chosen, ["id", "tie"]).select("id", "tie", shingles(F.col("text"), k).alias("hs"), "windows")
        cut = cut.select("id", "tie", F.inline(F.transform("windows", lambda w: F.struct(w["start"].alias("start"), w["size"].alias("size"), F.slice("hs", w["start"] + 1, w["size"] - (k - 1)).alias("ws")))))
        windows = cut if windows is None else windows.union(cut)
    windows = stage(with_fingerprint(windows, "ws").withColumn("content", F.xxhash64("ws")), "leak-cut")
    kinds = stage(windows.groupBy("size", "content", "fp").agg(F.any_value("ws").alias("ws")), "leak-kinds")
    left = _blocks(kinds.select("size", "content", "fp"))
    right = _blocks(listed.select("item_id", "size", F.col("fp"))).select("item_id", "size", F.col("fp").alias("item_fp"), "block", "part")
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.lit(len(MASKS))
    for k, m in reversed(list(enumerate(MASKS))):
        first = F.when(apart.bitwiseAND(F.lit(m)) == 0, F.lit(k)).otherwise(first)
    pairs = left.join(right, ["size", "block", "part"]).where((first == F.col("block")) & (F.bit_count(apart) <= RADIUS)).select("size", "content", "fp", "item_id")
    both = pairs.join(kinds, ["size", "content", "fp"]).join(listed.select("item_id", "items", F.col("size").alias("_size")), "item_id").where("size = _size")
    both = both.withColumn("common", shared(F.col("ws"), F.col("items")))
    union = F.size("ws") + F.size("items") - F.col("common")
    true = both.where(100 * F.col("common") >= PERCENT * union).select("size", "content", "fp", "item_id", (F.col("common") / union).alias("similarity"))
    true = small(stage(true, "leak-true"))
    matched = windows.select("id", "tie", "start", "size", "content", "fp").join(true, ["size", "content", "fp"])
    best = matched.groupBy("id", "tie", "item_id").agg(F.max_by(F.struct("start", "size", "similarity"), F.struct("similarity", -F.col("start"))).alias("best"))
    return best.select("id", "tie", "item_id", "best.*")


def decontaminate(docs: DataFrame, items: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every document with the benchmark items that it holds: doc_id, `carry`, contaminated and matches.

    matches: item_id, start, size (words) and similarity of the best window, by item_id. A text shorter than
    an item is one window. Null, empty and blank texts and items match nothing, nor do null item_ids. Rows
    that repeat a doc_id and text share their result. Other columns are ignored; empty tables give no matches.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id")
    rows = docs.select(key, F.xxhash64("text", "doc_id").alias("tie"), "text", "doc_id", *carry)
    found = find(rows.select("id", "tie", "text"), items.select(F.col("item_id").cast("long").alias("item_id"), "text"))
    found = found.groupBy("id", "tie").agg(F.array_sort(F.collect_list(F.struct("item_id", "start", "size", "similarity"))).alias("matches"))
    found = small(stage(found, "leak-found"))
    joined = rows.join(found, ["id", "tie"], "left")
    empty = F.array().cast(found.schema["matches"].dataType)
    return joined.select("doc_id", *carry, F.col("matches").isNotNull().alias("contaminated"), F.coalesce("matches", empty).alias("matches"))
