"""Trees, reachability, page order and form queries over tables of objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.geometry import moved
from quire.sources.staging import cut, together


def tree_order(edges: DataFrame, doc: str) -> DataFrame:
    """(doc, node, parent, depth, path) of the trees in edges (doc, parent, ord, child); roots have a null parent.

    path sorts nodes in depth-first order. A child listed again, or below itself, is taken once: the place
    with the least path. Levels are joined one at a time until one is empty, and each is written to the shared
    folder, so no level is computed twice and trees may be of any depth.
    """
    key = F.format_string("%010d", F.col("ord").cast("long"))
    pairs = edges.select(doc, "parent", "ord", "child")
    level = edges.where("parent IS NULL").select(doc, F.col("child").alias("node"), F.lit(None).cast(edges.schema["parent"].dataType).alias("parent"), F.lit(0).alias("depth"), F.array(key).alias("path"), F.array(F.col("child")).alias("_above"))
    levels = [cut(level)]
    while levels[-1].limit(1).count():
        above = levels[-1].select(F.col(doc), F.col("node").alias("parent"), "path", "_above")
        level = above.join(pairs, [doc, "parent"]).where(~F.array_contains("_above", F.col("child")))
        levels.append(cut(level.select(doc, F.col("child").alias("node"), "parent", F.lit(len(levels)).alias("depth"), F.concat("path", F.array(key)).alias("path"), F.concat("_above", F.array("child")).alias("_above"))))
    found = together(levels).drop("_above")
    w = Window.partitionBy(doc, "node").orderBy("path")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def inherited(own: list[Column]) -> Column:
    """The nearest value that is set, from the node itself upwards."""
    return F.coalesce(*own)


def reachable(edges: DataFrame, starts: DataFrame, levels: int | None = None) -> DataFrame:
    """(doc, node) that starts (doc, node) reach along edges (doc, src, dst), starts included: a frontier a round."""
    pairs = edges.select("doc", F.col("src").alias("node"), "dst")
    seen = frontier = cut(starts.select("doc", "node").distinct())
    k = 0
    while (levels is None or k < levels) and frontier.limit(1).count():
        step = pairs.join(frontier, ["doc", "node"]).select("doc", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, ["doc", "node"], "left_anti"))
        seen, k = seen.union(frontier), k + 1
    return seen


def renumber(nodes: DataFrame, doc: str = "doc", node: str = "node", first: int = 1) -> DataFrame:
    """New consecutive object numbers in order of the old ones."""
    return nodes.withColumn("num", F.dense_rank().over(Window.partitionBy(doc).orderBy(node)) + (first - 1))


def move_page(pages: DataFrame, place: str, origin: Column, target: Column) -> DataFrame:
    return pages.withColumn(place, moved(F.col(place), origin, target))


def delete_page(pages: DataFrame, keys: list[str], place: str, at: Column) -> DataFrame:
    """Pages without the one at a place; those behind it move up."""
    return pages.where(F.col(place) != at).withColumn(place, F.when(F.col(place) > at, F.col(place) - 1).otherwise(F.col(place)))


def insert_page(pages: DataFrame, new: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Pages with new ones (same columns; place clamped to the document) put in; those from there on move down."""
    size = pages.groupBy(*keys).agg((F.max(place) + 1).alias("_n"))
    at = new.join(size, keys, "left").withColumn(place, F.greatest(F.lit(0), F.least(F.col(place), F.coalesce("_n", F.lit(0))))).drop("_n")
    shift = pages.join(at.select(*keys, F.col(place).alias("_at")), keys, "left")
    return shift.withColumn(place, F.when(F.col(place) >= F.col("_at"), F.col(place) + 1).otherwise(F.col(place))).drop("_at").unionByName(at)


def merge(first: DataFrame, second: DataFrame, place: str, at: Column, first_size: Column, second_size: Column) -> DataFrame:
    """Both documents' pages: the second's stand at `at` (clamped), the first's from there on follow."""
    where = F.greatest(F.lit(0), F.least(at, first_size))
    a = first.withColumn(place, F.when(F.col(place) >= where, F.col(place) + second_size).otherwise(F.col(place)))
    return a.unionByName(second.withColumn(place, F.col(place) + where))


def split(pages: DataFrame, chosen: DataFrame, keys: list[str], place: str) -> DataFrame:
    """The chosen pages (keys, indices) in the order chosen; an index named twice counts once, its first place."""
    wanted = chosen.select(*keys, F.posexplode(F.array_distinct("indices")).alias("_to", place))
    return pages.join(wanted, [*keys, place]).withColumn(place, F.col("_to")).drop("_to")


def annotations(pages: DataFrame, annots: str = "annots") -> DataFrame:
    """Visible annotations of pages (doc, page, annots array of struct flags, rect, subtype, color): idx counts all entries."""
    rows = pages.select("doc", "page", F.posexplode(annots).alias("idx", "a"))
    hidden = F.coalesce(F.col("a.flags"), F.lit(0)).bitwiseAND(F.lit(0x2 | 0x20)) != 0
    return rows.where(~hidden & (F.size("a.rect") >= 4)).select("doc", "page", "idx", "a.subtype", "a.rect", F.when(F.size("a.color") == 3, F.col("a.color")).alias("color"))


def fields_on_page(fields: DataFrame, page_annotations: DataFrame) -> DataFrame:
    """Fields whose object is listed among a page's annotations: a semi-join, never a list on the driver."""
    return fields.join(page_annotations, ["doc", "num"], "left_semi")


def without(array: Column, at: int) -> Column:
    """An array without the entry at an index."""
    return F.filter(array, lambda _, i: i != at)


def selected_index(options: Column, value: Column) -> Column:
    """Index of a choice field's value among its options, null if it is none of them."""
    return F.nullif(F.array_position(options, value) - 1, F.lit(-1))
