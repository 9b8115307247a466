"""Structure, version and geometry queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import geometry as G
from quire.operators import revisions as R
from quire.operators import structure as S
from quire.plans.catalog import query, table
from quire.sources.staging import shared_folder
from quire.streaming.requests import mark_stale


@query("page_move", """SELECT conv_id, turn, CASE WHEN turn = 0 THEN 2 WHEN turn BETWEEN 1 AND 2 THEN turn - 1 ELSE turn END AS place FROM conversations""")
def page_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").alias("place"))
    return S.move_page(rows, "place", F.lit(0), F.lit(2))


@query("page_delete", "SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn FROM conversations WHERE turn <> 1")
def page_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn")
    return S.delete_page(rows, ["conv_id"], "turn", F.lit(1))


@query("page_insert", """WITH size AS (SELECT conv_id, max(turn) + 1 AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, role, CASE WHEN turn >= least(1, n) THEN turn + 1 ELSE turn END AS turn FROM conversations JOIN size USING (conv_id)
UNION ALL SELECT conv_id, 'blank', least(1, n) FROM size""")
def page_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn")
    blank = rows.select("conv_id").distinct().select("conv_id", F.lit("blank").alias("role"), F.lit(1).cast("long").alias("turn"))
    return S.insert_page(rows, blank, ["conv_id"], "turn")


@query("merge_docs", """WITH size AS (SELECT conv_id, max(turn) + 1 AS n FROM conversations GROUP BY conv_id),
pairs AS (SELECT a.conv_id, a.n AS na, b.n AS nb FROM size a JOIN size b ON b.conv_id = a.conv_id + 1 WHERE a.conv_id % 2 = 0)
SELECT p.conv_id, c.role, CASE WHEN c.turn >= least(1, na) THEN c.turn + nb ELSE c.turn END AS turn FROM pairs p JOIN conversations c ON c.conv_id = p.conv_id
UNION ALL SELECT p.conv_id, c.role, c.turn + least(1, na) FROM pairs p JOIN conversations c ON c.conv_id = p.conv_id + 1""")
def merge_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn")
    size = rows.groupBy("conv_id").agg((F.max("turn") + 1).alias("n"))
    other = size.select((F.col("conv_id") - 1).alias("conv_id"), F.col("n").alias("nb"))
    pairs = size.where("conv_id % 2 = 0").join(other, "conv_id")
    first = rows.join(pairs, "conv_id")
    second = rows.withColumn("conv_id", F.col("conv_id") - 1).join(pairs, "conv_id")
    return S.merge(first, second, "turn", F.lit(1), F.col("n"), F.col("nb")).select("conv_id", "role", "turn")


@query("split_docs", """WITH chosen AS (SELECT * FROM (VALUES (2, 0), (0, 1)) AS t(turn, place))
SELECT conv_id, role, CAST(place AS BIGINT) AS turn FROM conversations JOIN chosen USING (turn)""")
def split_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn")
    chosen = rows.select("conv_id").distinct().withColumn("indices", F.array(F.lit(2), F.lit(0), F.lit(2)).cast("array<bigint>"))
    return S.split(rows, chosen, ["conv_id"], "turn").select("conv_id", "role", F.col("turn").cast("long").alias("turn"))


@query("rotate_normalise", """WITH turned AS (SELECT p_partkey, ((p_size * 37 - 900) % 360 + 360) % 360 AS angle, p_retailprice AS w FROM part),
q AS (SELECT *, CASE WHEN angle >= 315 OR angle < 45 THEN 0 WHEN angle < 135 THEN 90 WHEN angle < 225 THEN 180 ELSE 270 END AS quarter FROM turned)
SELECT p_partkey, angle, quarter, CAST(greatest(round(CASE WHEN quarter IN (90, 270) THEN 792 ELSE w END * 1.5), 1) AS INT) AS width FROM q""")
def rotate_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    angle = G.rotate(F.col("p_size") * 37, F.lit(-900))
    rows = table(spark, sf_dir, "part").select("p_partkey", angle.alias("angle"), "p_retailprice")
    width, _ = G.pixel_size(F.col("p_retailprice"), F.lit(792.0), F.col("angle"), F.lit(1.5))
    return rows.select("p_partkey", "angle", G.quarter(F.col("angle")).alias("quarter"), width.alias("width"))


@query("cmyk_to_rgb", """SELECT l_orderkey, l_linenumber, CAST(round(255 * (1 - l_discount) * (1 - l_tax)) AS INT) AS r, CAST(round(255 * (1 - l_tax) * (1 - l_tax)) AS INT) AS g, CAST(round(255 * (1 - l_quantity / 50) * (1 - l_tax)) AS INT) AS b FROM lineitem""")
def cmyk_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = G.cmyk_to_rgb(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50, F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(c.alias(n) for c, n in zip(rgb, "rgb", strict=True)))


@query("affine_apply", """SELECT l_orderkey, l_linenumber, round(1.5 * l_quantity + 0.25 * l_discount + 72, 6) AS x, round(-0.5 * l_quantity + 2 * l_discount + l_tax, 6) AS y FROM lineitem""")
def affine_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = dict(zip("abcdef", map(F.lit, (1.5, -0.5, 0.25, 2.0, 72.0, 0.0)), strict=True)) | {"f": F.col("l_tax")}
    x, y = G.apply_matrix(m, F.col("l_quantity"), F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("quad_rescale", """SELECT l_orderkey, l_linenumber, round(10 + (l_quantity - 0) * (110 - 10) / 50, 6) AS x FROM lineitem""")
def quad_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = F.lit
    x = G.rescale(F.col("l_quantity"), (lit(0.0), lit(50.0)), (lit(10.0), lit(110.0)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(x, 6).alias("x"))


@query("screen_points", """SELECT l_orderkey, l_linenumber, round((l_quantity - 5) * 1.25, 6) AS sx, round((792 - l_discount) * 1.25, 6) AS sy, round(5 + l_quantity / 1.25, 6) AS px, round(792 - l_discount / 1.25, 6) AS py FROM lineitem""")
def screen_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = (F.col("l_quantity"), F.col("l_discount"), F.lit(5.0), F.lit(792.0), F.lit(1.25))
    named = zip((*G.to_screen(*args), *G.to_page(*args)), ("sx", "sy", "px", "py"), strict=True)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.round(c, 6).alias(n) for c, n in named))


@query("fit_scale", """SELECT p_partkey, round(greatest(0.1, least(10.0, (800 - 4) / p_retailprice, (600 - 4) / (p_size * 20.0))), 6) AS scale FROM part""")
def fit_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale = G.fit_scale(F.lit(800), F.lit(600), F.col("p_retailprice"), F.col("p_size") * 20.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(scale, 6).alias("scale"))


@query("bbox_union", """SELECT l_orderkey, min(l_quantity) AS x0, min(l_discount) AS y0, max(l_quantity + l_tax) AS x1, max(l_discount + 1) AS y1 FROM lineitem GROUP BY l_orderkey""")
def bbox_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("x0"), F.col("l_discount").alias("y0"), (F.col("l_quantity") + F.col("l_tax")).alias("x1"), (F.col("l_discount") + 1).alias("y1"))
    return G.bounding(rows, ["l_orderkey"])


@query("matrix_product", """SELECT l_orderkey, l_linenumber, round(2 * l_quantity + 0.5 * l_tax, 6) AS a, round(3 * l_tax, 6) AS b, round(2 * l_discount - 0.5, 6) AS c, round(-3.0, 6) AS d, round(2 * 7 + 0.5 * l_quantity + 1, 6) AS e, round(3 * l_quantity + 2, 6) AS f FROM lineitem""")
def matrix_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t, d = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    first = {"a": q, "b": t, "c": d, "d": F.lit(-1.0), "e": F.lit(7.0), "f": q}
    out = G.then(first, dict(zip("abcdef", map(F.lit, (2.0, 0.0, 0.5, 3.0, 1.0, 2.0)), strict=True)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.round(out[k], 6).alias(k) for k in "abcdef"))


@query("device_points", """WITH p AS (SELECT p_partkey, p_size % 4 * 90 AS turn, CAST(p_size AS DOUBLE) AS x, CAST(p_size * 2 AS DOUBLE) AS y, p_retailprice AS w, 800.0::DOUBLE AS h FROM part)
SELECT p_partkey, round(1.5 * CASE turn WHEN 0 THEN x WHEN 90 THEN y WHEN 180 THEN w - x ELSE h - y END, 6) AS px, round(1.5 * CASE turn WHEN 0 THEN h - y WHEN 90 THEN x WHEN 180 THEN y ELSE w - x END, 6) AS py FROM p""")
def device_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of turned pages as pixels."""
    m = G.device_matrix(F.col("p_retailprice"), F.lit(800.0), F.col("p_size") % 4 * 90, F.lit(1.5))
    x, y = G.apply_matrix(m, F.col("p_size").cast("double"), (F.col("p_size") * 2).cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(x, 6).alias("px"), F.round(y, 6).alias("py"))


@query("resize_boxes", """SELECT l_orderkey, l_linenumber, l_quantity AS x0, l_discount AS y0, greatest(l_quantity + 4, l_quantity + 30 - l_linenumber * 10) AS x1, greatest(l_discount + 4, l_discount + 9 + l_tax) AS y1 FROM lineitem""")
def resize_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = F.col("l_quantity"), F.col("l_discount")
    box = G.resized(q, d, q + 30, d + 9, F.col("l_linenumber") * -10, F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(x.alias(n) for x, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)))


@query("go_to_page", """WITH t AS (SELECT event_id, CASE WHEN event_type = 'click' THEN event_type ELSE concat(' ', CAST(event_id % 40 AS VARCHAR)) END AS typed FROM events)
SELECT event_id, CAST(CASE WHEN try_cast(trim(typed) AS INT) BETWEEN 1 AND 25 THEN try_cast(trim(typed) AS INT) - 1 END AS INT) AS page FROM t""")
def go_to_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page numbers that readers type, some of them none or beyond the document."""
    typed = F.when(F.col("event_type") == "click", F.col("event_type")).otherwise(F.concat(F.lit(" "), F.col("event_id") % 40))
    return table(spark, sf_dir, "events").select("event_id", G.go_to(typed, F.lit(25)).alias("page"))


@query("newest_revision", """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def newest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return R.newest(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("newest_trailer_key", """SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type""")
def newest_trailer_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.newest_values(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", F.struct("ts", "event_id"))


@query("overlay_read", """SELECT coalesce(c.c_custkey, o.k) AS c_custkey, coalesce(o.v, c.c_acctbal) AS c_acctbal FROM customer c FULL JOIN (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o ON o.k = c.c_custkey""")
def overlay_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return R.overlay(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), pending, ["c_custkey"], "c_acctbal")


@query("xref_sections", """SELECT o_custkey, min(o_orderkey) AS first, CAST(count(*) AS BIGINT) AS count FROM (SELECT o_custkey, o_orderkey, o_orderkey - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS g FROM orders) GROUP BY o_custkey, g""")
def xref_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sections(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey")


@query("number_runs", """SELECT min(k) AS first, CAST(count(*) AS BIGINT) AS count FROM (SELECT k, k - row_number() OVER (ORDER BY k) AS g FROM (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'F')) GROUP BY g""")
def number_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.runs_of_numbers(table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'"), "o_orderkey", 1 << 12)


SQL_USER_EVENTS = """ev AS (SELECT user_id, event_id, {value}, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)"""


@query("undo_redo_state", f"""WITH RECURSIVE {SQL_USER_EVENTS.format(value="CASE event_type WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE 'commit' END AS action")},
run(user_id, n, done, undone) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM ev
  UNION ALL SELECT r.user_id, e.n,
    CASE action WHEN 'commit' THEN list_append(done, event_id) WHEN 'undo' THEN done[1:len(done) - 1] ELSE CASE WHEN len(undone) > 0 THEN list_append(done, undone[len(undone)]) ELSE done END END,
    CASE action WHEN 'commit' THEN [] WHEN 'undo' THEN CASE WHEN len(done) > 0 THEN list_append(undone, done[len(done)]) ELSE undone END ELSE undone[1:len(undone) - 1] END
  FROM run r JOIN ev e ON e.user_id = r.user_id AND e.n = r.n + 1),
last AS (SELECT user_id, arg_max(done, n) AS done FROM run GROUP BY user_id)
SELECT ev.user_id, event_id AS seq, list_contains(done, event_id) AS alive FROM ev JOIN last ON last.user_id = ev.user_id WHERE action = 'commit'""")
def undo_redo_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("commit")
    return R.replay(table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), action.alias("action")), "user_id")


@query("stale_requests", """SELECT event_id, user_id, round(value) < max(round(value)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stale FROM events""")
def stale_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("generation", F.round("value"))
    return R.fresh_requests(rows, "user_id", ["ts", "event_id"], "generation").select("event_id", "user_id", "stale")


@query("stale_requests_stream", """SELECT event_id, user_id, round(value) < max(round(value)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stale FROM events""")
def stale_requests_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same decisions from a stream of the table, with one number of state a user."""
    path, folder = f"{sf_dir}/events.parquet", shared_folder(spark, "stream")
    files = f"{sf_dir}/events.[p]arquet"  # a pattern, as a stream takes a single file only that way
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(files).withColumn("generation", F.round("value"))
    found = mark_stale(rows, "user_id", ["ts", "event_id"], "generation", ["event_id"])
    found.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/rows")


@query("fifo_cache", f"""WITH RECURSIVE {SQL_USER_EVENTS.format(value="concat(event_type, '/', CAST(floor(value / 10) AS BIGINT)) AS item")},
run(user_id, n, seq, held, hit) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS VARCHAR[]), FALSE FROM ev
  UNION ALL SELECT r.user_id, e.n, e.event_id, CASE WHEN list_contains(held, item) THEN held ELSE list_append(CASE WHEN len(held) = 4 THEN held[2:] ELSE held END, item) END, list_contains(held, item)
  FROM run r JOIN ev e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, seq, hit FROM run WHERE n > 0""")
def fifo_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.concat_ws("/", "event_type", F.floor(F.col("value") / 10)).alias("item"))
    return R.fifo_cache(rows, "user_id", 4)


@query("fields_on_page", "SELECT o_orderkey AS num, o_custkey AS doc FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45)")
def fields_on_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("num"), F.col("o_custkey").alias("doc"))
    listed = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("num")).join(orders, "num").select("doc", "num")
    return S.fields_on_page(orders, listed)


@query("choice_options", """WITH o AS (SELECT p_brand, list_sort(list_distinct(list(p_type))) AS options, min(p_type) AS low, max(p_type) AS high FROM part GROUP BY p_brand)
SELECT p_brand, CAST(len(options) AS INT) AS n_options, CAST(list_position(options, high) - 1 AS BIGINT) AS selected, CAST(NULL AS BIGINT) AS missing FROM o""")
def choice_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("options"), F.max("p_type").alias("high"))
    return rows.select("p_brand", F.size("options").alias("n_options"), S.selected_index(F.col("options"), F.col("high")).alias("selected"), S.selected_index(F.col("options"), F.lit("none such")).alias("missing"))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and suppliers as one outline: node names carry their kind."""
    region = table(spark, sf_dir, "region").select(F.lit(0).alias("doc"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").cast("long").alias("ord"), F.concat(F.lit("r"), "r_regionkey").alias("child"))
    nation = table(spark, sf_dir, "nation").select(F.lit(0).alias("doc"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_nationkey").cast("long").alias("ord"), F.concat(F.lit("n"), "n_nationkey").alias("child"))
    supplier = table(spark, sf_dir, "supplier").select(F.lit(0).alias("doc"), F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.col("s_suppkey").alias("ord"), F.concat(F.lit("s"), "s_suppkey").alias("child"))
    return region.union(nation).union(supplier)


SQL_TREE = """edges AS (SELECT CAST(NULL AS VARCHAR) AS parent, r_regionkey AS ord, concat('r', r_regionkey) AS child FROM region
  UNION ALL SELECT concat('r', n_regionkey), n_nationkey, concat('n', n_nationkey) FROM nation
  UNION ALL SELECT concat('n', s_nationkey), s_suppkey, concat('s', s_suppkey) FROM supplier)"""


@query("outline_tree", f"""WITH RECURSIVE {SQL_TREE},
tree AS (SELECT child AS node, parent, 0 AS depth, printf('%010d', ord) AS path FROM edges WHERE parent IS NULL
  UNION ALL SELECT e.child, e.parent, t.depth + 1, concat(t.path, '/', printf('%010d', e.ord)) FROM tree t JOIN edges e ON e.parent = t.node)
SELECT node, parent, depth, path FROM tree""")
def outline_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tree_order(_tree(spark, sf_dir), "doc").select("node", "parent", "depth", F.array_join("path", "/").alias("path"))


@query("reachable_objects", """WITH RECURSIVE edges AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem),
seen AS (SELECT CAST(1 AS BIGINT) AS node UNION SELECT dst FROM seen JOIN edges ON src = node)
SELECT node FROM seen""")
def reachable_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What supplier 1 reaches: its parts, the parts of suppliers of their numbers, and so on."""
    edges = table(spark, sf_dir, "lineitem").select(F.lit(0).alias("doc"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return S.reachable(edges, spark.range(1, 2).select(F.lit(0).alias("doc"), F.col("id").alias("node"))).select("node")


@query("renumber_objects", """SELECT o_custkey, o_orderkey, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS num FROM orders""")
def renumber_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.renumber(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")
