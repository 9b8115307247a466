"""Queries through PDF files: rows of the driver's tables become files, and the readers' tables give them back.

The files come from made_files, which shares no code with the readers; the SQL states what the files were made of.
"""

from __future__ import annotations

import base64
import json
import zlib
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import editing
from quire.operators import text as T
from quire.plans import made_files as M
from quire.plans.catalog import query, table
from quire.sources.pdf.tables import flat_glyphs, pdf_table, pdf_tables

#: A text as its page gives it back: lines without characters leave no trace. The other keeps to one byte a character.
SQL_LINES = r"trim(regexp_replace(text, '\n+', chr(10), 'g'), chr(10))"
SQL_WORDS = r"regexp_replace(text, '[^\x20-\x7E\n]', '?', 'g')"


def _turns(spark: SparkSession, sf_dir: str, text: str = "text") -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.expr(text))
    return M.gathered(rows.select("conv_id", "turn", "text", "role"), "conv_id", ["turn"], "text", "role")


def _parts_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, dealt out: their rows are so short that a few tasks scan them all, and making and reading files takes a millisecond each."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


def _ascii(column: str = "text") -> str:
    return f"regexp_replace(coalesce({column}, ''), '[^\\\\x20-\\\\x7E\\n]', '?')"


def _texts(files: DataFrame, key: str = "conv_id") -> DataFrame:
    found = pdf_table(files, "page_text").where("error IS NULL")
    return found.select(F.col("doc").cast("long").alias(key), F.col("page").cast("long").alias("page"), "text")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_ascii()).alias("text"))


SQL_TURNS = f"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS page, {SQL_LINES.replace('text', SQL_WORDS, 1)} AS text FROM conversations"
SQL_DOCUMENTS = f"SELECT doc_id, CAST(0 AS BIGINT) AS page, {SQL_LINES.replace('text', SQL_WORDS, 1)} AS text FROM documents"


@query("pdf_page_text", SQL_TURNS)
def pdf_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each turn, simple fonts, a classic table of offsets."""
    files = M.files(_turns(spark, sf_dir, _ascii()), lambda r: M.classic(M.paged(M.stream(M.simple_text(x["text"])) for x in r["rows"])), "conv_id")
    return _texts(files)


@query("pdf_glyph_lines", SQL_TURNS)
def pdf_glyph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages as glyph rows, their lines rebuilt from places."""
    files = M.files(_turns(spark, sf_dir, _ascii()), lambda r: M.classic(M.paged(M.stream(M.simple_text(x["text"])) for x in r["rows"])), "conv_id")
    pages = pdf_table(files, "pages").select("doc", "page")
    found = T.page_text(flat_glyphs(pdf_table(files, "glyphs")), ["doc", "page"])
    return pages.join(found, ["doc", "page"], "left").select(F.col("doc").cast("long").alias("conv_id"), F.col("page").cast("long").alias("page"), F.coalesce("text", F.lit("")).alias("text"))


@query("pdf_run_boxes", f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS page, lower({SQL_WORDS}) AS text FROM conversations),
lines AS (SELECT conv_id, page, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS piece FROM t),
pieces AS (SELECT conv_id, page, line, generate_subscripts(string_split(piece, 'tion'), 1) AS k, unnest(string_split(piece, 'tion')) AS piece, len(string_split(piece, 'tion')) AS n FROM lines),
placed AS (SELECT *, sum(length(piece) + 4) OVER (PARTITION BY conv_id, page, line ORDER BY k) - 4 AS col FROM pieces)
SELECT conv_id, page, round(72 + 7.2::DOUBLE * col, 3) AS x0, CAST(734 - 14 * line AS DOUBLE) AS y0, round(72 + 7.2::DOUBLE * (col + 4), 3) AS x1 FROM placed WHERE k < n""")
def pdf_run_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a phrase on pages of a font of one width, from each page's runs; some files are dealt to tasks by pages."""
    courier = "/Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding"
    files = M.files(_turns(spark, sf_dir, _ascii()), lambda r: M.classic(M.paged((M.stream(M.simple_text(x["text"])) for x in r["rows"]), courier)), "conv_id")
    files = files.withColumn("length", F.when(F.col("path") % 3 == 0, 1 << 30).otherwise(F.octet_length("content")))
    found = T.boxes_of_matches(pdf_table(files, "runs").where("error IS NULL"), "Tion", ["doc", "page"])
    return found.select(F.col("doc").cast("long").alias("conv_id"), F.col("page").cast("long").alias("page"), F.round("x0", 3).alias("x0"), "y0", F.round("x1", 3).alias("x1"))


@query("pdf_unicode_text", "SELECT doc_id, CAST(0 AS BIGINT) AS page, replace(text, chr(10), '') AS text FROM documents")
def pdf_unicode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in one string of a composite font whose map names every character."""

    def make(row: dict[str, Any]) -> bytes:
        text = (row["text"] or "").replace("\n", "")
        codes, font = M.identity_font(text)
        shown = b"BT /F1 9 Tf 72 700 Td <" + b"".join(b"%04X" % codes[c] for c in text) + b"> Tj ET"
        return M.classic(M.paged([M.stream(zlib.compress(shown), "/Filter /FlateDecode")]) | font)

    return _texts(M.files(table(spark, sf_dir, "documents").select("doc_id", "text"), make, "doc_id"), "doc_id")


@query("pdf_object_streams", SQL_TURNS)
def pdf_object_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects in compressed object streams, places in a predicted cross-reference stream."""
    files = M.files(_turns(spark, sf_dir, _ascii()), lambda r: M.packed(M.paged(M.stream(M.simple_text(x["text"])) for x in r["rows"])), "conv_id")
    return _texts(files)


@query("pdf_hybrid_sections", SQL_TURNS)
def pdf_hybrid_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of offsets for old readers that points to a cross-reference stream with the rest."""
    files = M.files(_turns(spark, sf_dir, _ascii()), lambda r: M.hybrid(M.paged(M.stream(M.simple_text(x["text"])) for x in r["rows"])), "conv_id")
    return _texts(files)


@query("pdf_rebuilt", SQL_TURNS)
def pdf_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose table of offsets is gone: objects are found where they stand."""

    def make(row: dict[str, Any]) -> bytes:
        data = M.classic(M.paged(M.stream(M.simple_text(x["text"])) for x in row["rows"]))
        cut = data.rindex(b"xref\n", 0, data.rindex(b"startxref"))
        return data[:cut] + (b"trailer << /Root 1 0 R >>" if row["conv_id"] % 2 else b"")

    return _texts(M.files(_turns(spark, sf_dir, _ascii()), make, "conv_id"))


@query("pdf_wrong_lengths", SQL_TURNS)
def pdf_wrong_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams whose length is too short, too long, missing or held by another object."""

    def make(row: dict[str, Any]) -> bytes:
        objects = M.paged(M.stream(M.simple_text(x["text"])) for x in row["rows"])
        for k in range(len(row["rows"])):
            num, body = 11 + 2 * k, objects[11 + 2 * k]
            size = int(body.split(b"/Length ")[1].split()[0])
            other = [b"/Length %d" % max(0, size - 9), b"/Length %d" % (size + 40), b"", b"/Length 5 0 R"][(row["conv_id"] + k) % 4]
            objects[num] = body.replace(b"/Length %d" % size, other, 1)
        return M.classic(objects | {5: b"3"})

    return _texts(M.files(_turns(spark, sf_dir, _ascii()), make, "conv_id"))


@query("pdf_filters", SQL_DOCUMENTS)
def pdf_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content through Flate, LZW, ASCII85, ASCIIHex, chains of them, and PNG and TIFF predictors."""
    files = M.files(_documents(spark, sf_dir), lambda r: M.classic(M.paged([M.filtered(M.simple_text(r["text"]), r["doc_id"])])), "doc_id")
    return _texts(files, "doc_id")


@query("pdf_newest_content", f"""WITH t AS (SELECT conv_id, turn, {SQL_LINES.replace('text', SQL_WORDS, 1)} AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n, count(*) OVER (PARTITION BY conv_id) AS revisions FROM conversations)
SELECT conv_id, text, CAST(revisions AS INT) AS revisions FROM t WHERE n = 1""")
def pdf_newest_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page whose content every turn replaces by a revision behind the file; the newest stands."""

    def make(row: dict[str, Any]) -> bytes:
        first, *later = (M.stream(M.simple_text(x["text"])) for x in row["rows"])
        data = M.classic(M.paged([first]))
        for body in later:
            data = M.revised(data, {11: body})
        return data

    files = M.files(_turns(spark, sf_dir, _ascii()), make, "conv_id")
    found = pdf_table(files, "files").select(F.col("doc").cast("long").alias("conv_id"), "revisions")
    return _texts(files).select("conv_id", "text").join(found, "conv_id")


@query("pdf_sections", """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS section_ord, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, CAST(section_ord AS INT) AS section_ord, CAST(CASE WHEN section_ord = n - 1 THEN 6 ELSE 1 END AS BIGINT) AS entries, CAST(CASE WHEN section_ord = n - 1 THEN 1 ELSE 0 END AS BIGINT) AS free,
  CASE WHEN section_ord = n - 1 THEN '13' ELSE '9999' END AS size FROM t""")
def pdf_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and trailers of each cross-reference section, newest first."""

    def make(row: dict[str, Any]) -> bytes:
        data = M.classic(M.paged([M.stream(b"")]) | {12: b"null"})
        for k in range(1, len(row["rows"])):
            data = M.revised(data, {12: b"%d" % k})
        return data

    files = M.files(_turns(spark, sf_dir), make, "conv_id")
    entries = pdf_table(files, "xref").groupBy("doc", "section_ord").agg(F.count_if(F.col("kind") != "free").alias("entries"), F.count_if(F.col("kind") == "free").alias("free"))
    sizes = pdf_table(files, "trailer").where("key = 'Size'").select("doc", "section_ord", F.col("value").alias("size"))
    return entries.join(sizes, ["doc", "section_ord"]).select(F.col("doc").cast("long").alias("conv_id"), "section_ord", "entries", "free", "size")


@query("object_count", "SELECT o_custkey, CAST(count(*) + 4 AS INT) AS objects, CAST(max(o_orderkey) + 101 AS INT) AS next_free FROM orders GROUP BY o_custkey")
def object_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of a file and the first number behind them."""
    rows = M.gathered(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"])
    files = M.files(rows, lambda r: M.classic({k: v for k, v in M.paged([M.stream(b"")]).items() if k != 3} | {100 + x["o_orderkey"]: b"(x)" for x in r["rows"]}), "o_custkey")
    return pdf_table(files, "files").select(F.col("doc").cast("long").alias("o_custkey"), F.col("n_objects").alias("objects"), "next_free")


@query("pdf_objects", """SELECT l_orderkey, CAST(100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus, l_quantity) AS INT) AS num, concat(CASE l_returnflag WHEN 'A' THEN 'a b' ELSE l_returnflag END, '|', CAST(l_linenumber AS VARCHAR), '|', CASE WHEN l_linestatus = 'O' THEN 'true' ELSE 'null' END) AS fields,
  CAST(CASE WHEN row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus, l_quantity) = 1 THEN NULL ELSE 99 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus, l_quantity) END AS INT) AS points_to FROM lineitem""")
def pdf_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of every kind, read back from their own notation, and the references between objects."""
    rows = M.gathered(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity"), "l_orderkey", ["l_linenumber"], "l_returnflag", "l_linestatus", "l_quantity")

    def body(k: int, x: dict[str, Any]) -> bytes:
        flag = "/a#20b" if x["l_returnflag"] == "A" else f"/{x['l_returnflag']}"
        back = f"/Q {100 + k} 0 R" if k else ""
        return f"<</F{flag}%note\n/N {x['l_linenumber']}/S({x['l_quantity']}\\040\\(\\))/L[{'true' if x['l_linestatus'] == 'O' else 'null'} <4a4B>] {back}>>".encode()

    files = M.files(rows, lambda r: M.classic(M.paged([M.stream(b"")]) | {101 + k: body(k, x) for k, x in enumerate(r["rows"])}), "l_orderkey")
    value = F.col("value")
    flag, number, first = (F.regexp_extract(value, p, 1) for p in (r"/F ?/([A-Za-z#0-9]+)", r"/N (\d+)", r"/L ?\[(\w+)"))
    fields = F.concat_ws("|", F.replace(flag, F.lit("#20"), F.lit(" ")), number, first)
    found = pdf_table(files, "objects").where("num > 100")
    return found.select(F.col("doc").cast("long").alias("l_orderkey"), "num", fields.alias("fields"), F.explode_outer("refs.dst").alias("points_to"))


SQL_NAMES = "SELECT s_suppkey, s_name AS text FROM supplier"


@query("pdf_rc4", SQL_NAMES)
def pdf_rc4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RC4 with 40 and 128 bits under a password each."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    files = M.files(rows, lambda r: M.encrypted([M.simple_text(r["s_name"])], b"pw%d" % r["s_suppkey"], 2 + r["s_suppkey"] % 2), "s_suppkey")
    return _texts(files.withColumn("password", F.concat(F.lit("pw"), "path")), "s_suppkey").select("s_suppkey", "text")


@query("pdf_aes128", SQL_NAMES)
def pdf_aes128(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    files = M.files(rows, lambda r: M.encrypted([M.simple_text(r["s_name"])], b"" if r["s_suppkey"] % 2 else b"secret", 4), "s_suppkey")
    return _texts(files.withColumn("password", F.when(F.col("path") % 2 == 0, "secret")), "s_suppkey").select("s_suppkey", "text")


@query("pdf_aes256", "SELECT n_nationkey, n_name AS text FROM nation")
def pdf_aes256(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AES-256 in its first form, and for every eighth nation with the iterated hash of revision 6."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name").repartition(8)
    files = M.files(rows, lambda r: M.encrypted([M.simple_text(r["n_name"])], b"secret", 6 if r["n_nationkey"] % 8 == 0 else 5), "n_nationkey")
    return _texts(files.withColumn("password", F.lit("secret")), "n_nationkey").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "text")


@query("pdf_errors", """SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'IncorrectPassword' WHEN 1 THEN 'UnsupportedFilter' WHEN 2 THEN 'MissingRoot' WHEN 3 THEN 'FilterError' END AS code, CASE WHEN s_suppkey % 5 = 4 THEN s_name END AS text FROM supplier""")
def pdf_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad files among good ones are rows with an error each, and the job goes on."""

    def make(row: dict[str, Any]) -> bytes:
        shown, kind = M.simple_text(row["s_name"]), row["s_suppkey"] % 5
        if kind == 0:
            return M.encrypted([shown], b"other", 3)
        if kind == 2:
            return b"%PDF-1.4\n" + shown
        body = [M.stream(shown, "/Filter /JPXDecode"), b"", M.stream(zlib.compress(shown)[:-8], "/Filter /FlateDecode"), M.stream(shown)][kind - 1]
        return M.classic(M.paged([body]))

    files = M.files(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), make, "s_suppkey")
    return pdf_table(files, "page_text").select(F.col("doc").cast("long").alias("s_suppkey"), F.col("error.code").alias("code"), "text")


@query("digest_ranges", """SELECT n_nationkey, n_name AS signer, r_name AS reason, CASE n_nationkey % 5 WHEN 0 THEN 'Valid' WHEN 1 THEN 'ContentModified' WHEN 2 THEN 'Malformed' WHEN 3 THEN 'SignatureInvalid' ELSE 'Valid' END AS status,
  CASE WHEN n_nationkey % 5 <> 2 THEN n_name END AS signer_cn, n_nationkey % 5 <> 4 AS covers_whole_file FROM nation JOIN region ON r_regionkey = n_regionkey""")
def digest_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed files: whole, altered, cut, with a forged signature, and with bytes behind the signed ranges."""
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    rows = table(spark, sf_dir, "nation").join(region, "n_regionkey").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", "r_name")

    def make(row: dict[str, Any]) -> bytes:
        kind = row["n_nationkey"] % 5
        data = M.signed_file(row["n_name"], row["n_name"], row["r_name"], M.key_pair(), True)
        if kind == 1:
            return data.replace(b"72 734 Td", b"72 735 Td")
        hole = data.index(b"/Contents <30") + 11
        if kind == 2:  # the outermost element says that there is more
            return data[:hole] + b"3082FFFF" + data[hole + 8 :]
        if kind == 3:  # the last bytes of the signature itself, in front of the zeros that fill the hole
            end = hole + len(data[hole : data.index(b">", hole)].rstrip(b"0")) - 8
            return data[:end] + bytes(49 if c == 48 else 48 for c in data[end : end + 4]) + data[end + 4 :]
        return data + b"\n% more\n" if kind == 4 else data

    found = pdf_table(M.files(rows, make, "n_nationkey"), "signatures")
    return found.select(F.col("doc").cast("int").alias("n_nationkey"), "signer", "reason", "status", "signer_cn", "covers_whole_file")


@query("inherit_attrs", """SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS BIGINT) AS page, CASE WHEN c_acctbal > 5000 THEN c_custkey % 700 + 100.0 ELSE CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey + 200.0 ELSE 612.0 END END AS width,
  CAST(CASE WHEN c_custkey % 4 = 0 THEN 90 WHEN n_regionkey % 2 = 0 THEN 180 ELSE 0 END AS INT) AS rotate FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def inherit_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes and turns that pages have of their own, of the node above or of the root of the tree."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    rows = M.gathered(table(spark, sf_dir, "customer").join(nation, "c_nationkey").select("c_nationkey", "c_custkey", "c_acctbal", "n_regionkey"), "c_nationkey", ["c_custkey"], "c_acctbal", "n_regionkey")

    def make(row: dict[str, Any]) -> bytes:
        nation, people = row["c_nationkey"], row["rows"]
        top = "/Rotate 180" if people[0]["n_regionkey"] % 2 == 0 else ""
        middle = f"/MediaBox [0 0 {nation + 200} 300]" if nation % 3 == 0 else ""
        objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Kids [5 0 R] /Count {len(people)} {top} >>".encode()}
        objects[5] = f"<< /Type /Pages /Parent 2 0 R /Kids [{' '.join(f'{100 + k} 0 R' for k in range(len(people)))}] /Count {len(people)} {middle} >>".encode()
        for k, x in enumerate(people):
            box = f"/MediaBox [0 0 {x['c_custkey'] % 700 + 100} 400]" if x["c_acctbal"] > 5000 else ""
            turn = "/Rotate 90" if x["c_custkey"] % 4 == 0 else ""
            objects[100 + k] = f"<< /Type /Page /Parent 5 0 R /Id {x['c_custkey']} {box} {turn} >>".encode()
        return M.classic(objects)

    files = M.files(rows, make, "c_nationkey")
    own = pdf_table(files, "objects").where("num >= 100").select("doc", F.col("num").alias("obj_num"), F.regexp_extract("value", r"/Id (\d+)", 1).cast("long").alias("c_custkey"))
    return pdf_table(files, "pages").join(own, ["doc", "obj_num"]).select("c_custkey", F.col("page").cast("long").alias("page"), F.get("media_box", F.lit(2)).alias("width"), "rotate")


@query("display_summary", """SELECT user_id, CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS paths, CAST(coalesce(sum(length(event_type)) FILTER (event_type <> 'click'), 0) AS BIGINT) AS glyphs, bool_or(event_type = 'error') AS any_estimated FROM events GROUP BY user_id""")
def display_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of display items; clicks are paths, the other events words, errors in a font that is missing."""
    rows = M.gathered(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", ["event_id"], "event_type")

    def make(row: dict[str, Any]) -> bytes:
        shown = [b"0 0 5 5 re f" if x["event_type"] == "click" else b"BT /%s 9 Tf (%s) Tj ET" % (b"F9" if x["event_type"] == "error" else b"F1", x["event_type"].encode()) for x in row["rows"]]
        return M.classic(M.paged([M.stream(b"\n".join(shown))]))

    found = pdf_table(M.files(rows, make, "user_id"), "summary")
    return found.select(F.col("doc").cast("long").alias("user_id"), "paths", "glyphs", "any_estimated")


@query("pdf_path_boxes", """SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_tax, l_discount) - 1 AS BIGINT) AS seq, CASE WHEN l_linenumber % 2 = 0 THEN 'f' ELSE 's' END AS paint,
  round(2 * l_quantity + 10, 4) AS x0, round(3 * l_tax + 20, 4) AS y0, round(2 * (l_quantity + 7) + 10, 4) AS x1, round(3 * (l_tax + l_discount + 1) + 20, 4) AS y1 FROM lineitem""")
def pdf_path_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles and lines under a matrix that a saved state takes back after each."""
    rows = M.gathered(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_discount"), "l_orderkey", ["l_linenumber"], "l_quantity", "l_tax", "l_discount")

    def draw(x: dict[str, Any]) -> str:
        w, h = 7, x["l_discount"] + 1
        left, low = x["l_quantity"], x["l_tax"]
        if x["l_linenumber"] % 2 == 0:
            return f"q 2 0 0 3 10 20 cm {left} {low} {w} {h:.9f} re f Q"
        return f"q 2 0 0 1 10 0 cm 1 0 0 3 0 20 cm {left} {low} m {left + w} {low + h:.9f} l S Q"

    files = M.files(rows, lambda r: M.classic(M.paged([M.stream("\n".join(map(draw, r["rows"])).encode())])), "l_orderkey")
    found = pdf_table(files, "items").where("kind = 'path'")
    return found.select(F.col("doc").cast("long").alias("l_orderkey"), "seq", "paint", *(F.round(F.get("box", F.lit(k)), 4).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))))


@query("pdf_instructions", """SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) * 3 - 3 AS BIGINT) AS seq, role AS tag FROM conversations""")
def pdf_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions with their operands, inline images and comments among them."""

    def make(row: dict[str, Any]) -> bytes:
        shown = [b"/%s BMC %% a note\nBI /W 1 /H 1 ID \x00EI~EMC\x01\nEI EMC" % x["role"].encode() for x in row["rows"]]
        return M.classic(M.paged([M.stream(b"\n".join(shown))]))

    found = pdf_table(M.files(_turns(spark, sf_dir), make, "conv_id"), "instructions").where("op = 'BMC'")
    return found.select(F.col("doc").cast("long").alias("conv_id"), "seq", F.regexp_extract("operands", r"/(\w+)", 1).alias("tag"))


#: Public widths of the capitals and small letters that names of regions have, by font.
WIDTHS = {
    "Helvetica": dict(zip("AEIOUMRCFSDLTaeioumrcfsdltp ", (667, 667, 278, 778, 722, 833, 722, 722, 611, 667, 722, 556, 611, 556, 556, 222, 556, 556, 833, 333, 500, 278, 500, 556, 222, 278, 556, 278), strict=True)),
    "Helvetica-Bold": dict(zip("AEIOUMRCFSDLTaeioumrcfsdltp ", (722, 667, 278, 778, 722, 833, 722, 722, 611, 667, 722, 611, 611, 556, 556, 278, 611, 611, 889, 389, 556, 333, 556, 611, 278, 333, 611, 278), strict=True)),
    "Times-Italic": dict(zip("AEIOUMRCFSDLTaeioumrcfsdltp ", (611, 611, 333, 722, 722, 833, 611, 667, 611, 500, 722, 556, 556, 500, 444, 278, 500, 500, 722, 389, 444, 278, 389, 500, 278, 278, 500, 250), strict=True)),
    "Courier": dict.fromkeys("AEIOUMRCFSDLTaeioumrcfsdltp ", 600),
}
SQL_WIDTHS = ", ".join(f"('{font}', '{c}', {w})" for font, own in WIDTHS.items() for c, w in own.items())
SQL_LETTERS = "regexp_replace({}, '[^AEIOUMRCFSDLTaeioumrcfsdltp ]', 'e', 'g')"


@query("pdf_glyph_widths", f"""WITH widths(font, ch, w) AS (VALUES {SQL_WIDTHS}),
names AS (SELECT n_nationkey, font, {SQL_LETTERS.format('n_name')} AS name FROM nation, (SELECT DISTINCT font FROM widths)),
chars AS (SELECT n_nationkey, font, generate_subscripts(string_split(name, ''), 1) - 1 AS k, unnest(string_split(name, '')) AS ch FROM names),
placed AS (SELECT n_nationkey, chars.font, k, chars.ch, sum(w * 0.01::DOUBLE + 0.5 + CASE WHEN chars.ch = ' ' THEN 2 ELSE 0 END) OVER (PARTITION BY n_nationkey, chars.font ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gone FROM chars JOIN widths ON widths.font = chars.font AND widths.ch = chars.ch)
SELECT n_nationkey, font, CAST(k AS BIGINT) AS seq, ch AS uni, round(72 + 0.8::DOUBLE * coalesce(gone, 0), 4) AS x, 703.0::DOUBLE AS y FROM placed""")
def pdf_glyph_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where glyphs of standard fonts stand, with spacing of characters and words, scaling and rise."""
    fonts = F.explode(F.array(*map(F.lit, WIDTHS)))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", fonts.alias("font"), F.regexp_replace("n_name", "[^AEIOUMRCFSDLTaeioumrcfsdltp ]", "e").alias("name"))
    rows = rows.withColumn("key", F.concat_ws("/", "n_nationkey", "font"))

    def make(row: dict[str, Any]) -> bytes:
        shown = b"BT /F1 10 Tf 0.5 Tc 2 Tw 80 Tz 3 Ts 1 0 0 1 72 700 Tm " + M.literal(row["name"].encode()) + b" Tj ET"
        return M.classic(M.paged([M.stream(shown)], f"/Type /Font /Subtype /Type1 /BaseFont /{row['font']} /Encoding /WinAnsiEncoding"))

    found = pdf_table(M.files(rows, make, "key"), "glyphs")
    key = F.split("doc", "/")
    return found.select(key[0].cast("int").alias("n_nationkey"), key[1].alias("font"), "seq", "uni", F.round("m.e", 4).alias("x"), F.round("m.f", 4).alias("y"))


@query("pdf_forms", """SELECT conv_id, replace(string_agg(regexp_replace(coalesce(text, ''), '[^\\x20-\\x7E]', '?', 'g'), '' ORDER BY turn), chr(10), '') AS text FROM conversations GROUP BY conv_id""")
def pdf_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text in forms, each nested in the one before; a reader follows a dozen levels."""

    def make(row: dict[str, Any]) -> bytes:
        parts = row["rows"]
        groups = [parts[k : k + 8] for k in range(0, len(parts), 8)]
        objects = M.paged([M.stream(b" ".join(b"/X%d Do" % g for g in range(len(groups))))])
        names = " ".join(f"/X{g} {100 + 10 * g} 0 R" for g in range(len(groups)))
        objects[2] = objects[2].replace(b"/Resources <<", f"/Resources << /XObject << {names} >>".encode())
        for g, group in enumerate(groups):
            for k, x in enumerate(group):
                inner = f"/XObject << /N {101 + 10 * g + k} 0 R >>" if k + 1 < len(group) else ""
                body = b"BT /F1 9 Tf 72 700 Td " + M.literal(x["text"].encode("latin-1")) + b" Tj ET " + (b"/N Do" if inner else b"")
                objects[100 + 10 * g + k] = M.stream(body, f"/Type /XObject /Subtype /Form /BBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> {inner} >>")
        return M.classic(objects)

    rows = _turns(spark, sf_dir, "regexp_replace(coalesce(text, ''), '[^\\\\x20-\\\\x7E]', '?')")
    return _texts(M.files(rows, make, "conv_id")).select("conv_id", "text")


@query("pdf_differences", "SELECT n_nationkey, translate(n_name, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS text FROM nation")
def pdf_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that an encoding gives other characters by name."""
    names = " ".join(f"/{chr(65 + k)}" for k in range(26))
    font = f"/Type /Font /Subtype /Type1 /BaseFont /Made /FirstChar 32 /Widths [500] /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [97 {names}] >>"
    files = M.files(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), lambda r: M.classic(M.paged([M.stream(M.simple_text(r["n_name"]))], font)), "n_nationkey")
    return _texts(files, "n_nationkey").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "text")


#: Names of characters in encodings and what they stand for.
NAMED = {"eacute": "é", "Agrave": "À", "ccedilla": "ç", "ntilde": "ñ", "space": " ", "quotesingle": "'", "endash": "–", "seven": "7", "uni20AC": "€", "u1F600": "😀", "odieresis": "ö", "scaron": "š", "braceleft": "{", "fi": "fi"}
SQL_NAMED = ", ".join(f"({k}, '{c.replace(chr(39), 2 * chr(39))}')" for k, c in enumerate(NAMED.values()))


@query("pdf_glyph_names", f"""WITH names(k, ch) AS (VALUES {SQL_NAMED})
SELECT n_nationkey, string_agg(ch, '' ORDER BY k) AS text FROM nation, names WHERE (n_nationkey + k) % 3 > 0 GROUP BY n_nationkey""")
def pdf_glyph_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes whose characters an encoding names."""
    names = " ".join(f"/{x}" for x in NAMED)
    font = f"/Type /Font /Subtype /Type1 /BaseFont /Made /Encoding << /Differences [128 {names}] >>"
    files = M.files(table(spark, sf_dir, "nation").select("n_nationkey"), lambda r: M.classic(M.paged([M.stream(b"BT /F1 9 Tf 9 9 Td " + M.literal(bytes(128 + k for k in range(len(NAMED)) if (r["n_nationkey"] + k) % 3)) + b" Tj ET")], font)), "n_nationkey")
    return _texts(files, "n_nationkey").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "text")


@query("pdf_composite_widths", """WITH chars AS (SELECT n_nationkey, generate_subscripts(string_split(n_name, ''), 1) - 1 AS k, unnest(string_split(n_name, '')) AS ch FROM nation),
codes AS (SELECT *, dense_rank() OVER (PARTITION BY n_nationkey ORDER BY ord(ch)) AS code FROM chars)
SELECT n_nationkey, CAST(k AS BIGINT) AS seq, ch AS uni, CAST(code AS INT) AS code, round(72 + coalesce(sum(CASE code WHEN 1 THEN 2.5::DOUBLE WHEN 2 THEN 6 WHEN 3 THEN 5 WHEN 4 THEN 5 ELSE CASE WHEN code <= 9 THEN 7 ELSE 5 END END) OVER (PARTITION BY n_nationkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS x FROM codes""")
def pdf_composite_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs of two-byte codes, whose widths come as lists, ranges and a default."""

    def make(row: dict[str, Any]) -> bytes:
        codes, font = M.identity_font(row["n_name"])
        return M.classic(M.paged([M.stream(b"BT /F1 10 Tf 72 700 Td <" + b"".join(b"%04X" % codes[c] for c in row["n_name"]) + b"> Tj ET")]) | font)

    found = pdf_table(M.files(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), make, "n_nationkey"), "glyphs")
    return found.select(F.col("doc").cast("int").alias("n_nationkey"), "seq", "uni", "code", F.round("m.e", 4).alias("x"))


@query("text_decode", "SELECT doc_id, text FROM documents")
def text_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as titles, in UTF-16 with a byte order mark."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = M.files(rows, lambda r: M.classic(M.paged([M.stream(b"")]) | {5: b"<< /Title " + M.string(r["text"] or "") + b" >>"}, "/Info 5 0 R"), "doc_id")
    return pdf_table(files, "files").select(F.col("doc").cast("long").alias("doc_id"), F.element_at("info", "Title").alias("text"))


@query("pdf_outline", """WITH n AS (SELECT *, row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS page, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS ord FROM nation)
SELECT r_name AS title, CAST(0 AS INT) AS depth, CAST(r_regionkey AS INT) AS ord, CAST(NULL AS VARCHAR) AS above, CAST(NULL AS INT) AS page FROM region
UNION ALL SELECT n_name, 1, CAST(ord AS INT), r_name, CAST(page AS INT) FROM n JOIN region ON r_regionkey = n_regionkey""")
def pdf_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations under their regions in an outline; nations lead to pages, regions nowhere."""
    nation, region = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey", "n_name"), table(spark, sf_dir, "region")
    rows = nation.join(region, "r_regionkey").withColumn("all", F.lit(0))
    rows = M.gathered(rows.select("all", "r_regionkey", "n_nationkey", "r_name", "n_name"), "all", ["r_regionkey", "n_nationkey"], "r_name", "n_name")

    def make(row: dict[str, Any]) -> bytes:
        people = row["rows"]
        regions = list(dict.fromkeys((x["r_regionkey"], x["r_name"]) for x in people))
        objects = M.paged([M.stream(b"") for _ in people], catalog="/Outlines 5 0 R") | {5: b"<< /First 1000 0 R >>"}
        for r, (key, name) in enumerate(regions):
            own = [k for k, x in enumerate(people) if x["r_regionkey"] == key]
            after = f"/Next {1001 + r} 0 R" if r + 1 < len(regions) else "/Next 1000 0 R"
            objects[1000 + r] = b"<< /Title " + M.string(name) + f" /First {2000 + own[0]} 0 R {after} >>".encode()
            for a, b in zip(own, [*own[1:], None], strict=True):
                after = f"/Next {2000 + b} 0 R" if b is not None else ""
                objects[2000 + a] = b"<< /Title " + M.literal(people[a]["n_name"].encode()) + f" /Dest [{10 + 2 * a} 0 R /Fit] {after} >>".encode()
        return M.classic(objects)

    found = pdf_table(M.files(rows, make, "all"), "outline")
    above = found.select(F.col("node").alias("parent"), F.col("title").alias("above"))
    return found.join(above, "parent", "left").select("title", "depth", "ord", "above", "page")


@query("pdf_annotations", """SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_discount, l_returnflag) - 1 AS INT) AS idx, CASE WHEN l_linenumber % 2 = 0 THEN 'Highlight' ELSE 'Square' END AS subtype, l_quantity AS x0, l_quantity + 10 AS x1,
  CASE WHEN l_linenumber % 3 = 0 THEN l_discount END AS red, l_returnflag = 'A' AS hidden FROM lineitem""")
def pdf_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations, inline and as objects, some of them hidden or with a colour."""
    rows = M.gathered(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag"), "l_orderkey", ["l_linenumber"], "l_quantity", "l_discount", "l_returnflag")

    def entry(x: dict[str, Any]) -> str:
        color = f"/C [{x['l_discount']} 0 1]" if x["l_linenumber"] % 3 == 0 else "/C [0.5]"
        kind = "Highlight" if x["l_linenumber"] % 2 == 0 else "Square"
        return f"<< /Subtype /{kind} /Rect [{x['l_quantity']} 0 {x['l_quantity'] + 10} 9] {color} /F {2 if x['l_returnflag'] == 'A' else 4} >>"

    def make(row: dict[str, Any]) -> bytes:
        entries = [entry(x) if k % 2 else f"{100 + k} 0 R" for k, x in enumerate(row["rows"])]
        objects = M.paged([M.stream(b"")], page=lambda _: f"/Annots [{' '.join(entries)}]")
        return M.classic(objects | {100 + k: entry(x).encode() for k, x in enumerate(row["rows"])})

    found = pdf_table(M.files(rows, make, "l_orderkey"), "annotations")
    return found.select(F.col("doc").cast("long").alias("l_orderkey"), "idx", "subtype", F.get("rect", F.lit(0)).alias("x0"), F.get("rect", F.lit(2)).alias("x1"), F.get("color", F.lit(0)).alias("red"), "hidden")


def _form(row: dict[str, Any]) -> bytes:
    """A form with a field for each part: text, check box, choice or group of radio buttons by its key."""
    objects, refs = {}, []
    for k, x in enumerate(row["rows"]):
        num, kind, name = 100 + 10 * k, x["p_partkey"] % 4, f"f{x['p_partkey']}"
        head = f"/T ({name}) /Rect [0 0 90 20]"
        states = "/AP << /N << /Off null /On null >> >>"
        if kind == 0:
            body = f"<< /FT /Tx {head} /V ".encode() + M.string(x["p_name"]) + b" >>"
        elif kind == 1:
            body = f"<< /FT /Btn {head} {states} /AS /{'On' if x['p_size'] % 2 else 'Off'} >>".encode()
        elif kind == 2:
            body = f"<< /FT /Ch {head} /Opt [({x['p_brand']}) [(other) (Other one)]] /V ({x['p_brand'] if x['p_size'] % 2 else 'other'}) >>".encode()
        else:
            on = x["p_size"] % 2
            body = f"<< /FT /Btn /Ff 32768 /T ({name}) /Kids [{num + 1} 0 R {num + 2} 0 R] /V /K{on} >>".encode()
            for j in (0, 1):
                objects[num + 1 + j] = f"<< /Parent {num} 0 R /Rect [{j} 0 {j + 9} 9] /AP << /N << /K{j} null /Off null >> >> /AS /{'K' + str(j) if j == on else 'Off'} >>".encode()
        objects[num] = body
        refs.append(f"{num} 0 R")
    return M.classic(M.paged([M.stream(b"")], catalog=f"/AcroForm << /Fields [{' '.join(refs)}] >>") | objects)


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 20).alias("doc"), "p_partkey", "p_name", "p_brand", "p_size")
    return M.files(M.gathered(rows, "doc", ["p_partkey"], "p_name", "p_brand", "p_size"), _form, "doc")


def _values(found: DataFrame) -> DataFrame:
    chosen = F.array_join(F.transform(F.filter("options", lambda o: o["selected"]), lambda o: o["label"]), ",")
    return found.select(F.substring("name", 2, 20).cast("long").alias("p_partkey"), "kind", F.when(F.col("kind") == "radio", chosen).otherwise(F.col("value")).alias("value"), F.coalesce(F.size("options"), F.lit(0)).alias("n_options"))


SQL_FIELDS = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'checkbox' WHEN 2 THEN 'choice' ELSE 'radio' END AS kind,
  CASE p_partkey % 4 WHEN 0 THEN {text} WHEN 1 THEN CASE WHEN p_size % 2 {odd} THEN 'true' ELSE 'false' END WHEN 2 THEN CASE WHEN p_size % 2 {odd} THEN p_brand ELSE 'other' END ELSE CASE WHEN p_size % 2 {odd} THEN 'K1' ELSE 'K0' END END AS value,
  CAST(CASE WHEN p_partkey % 4 >= 2 THEN 2 ELSE 0 END AS INT) AS n_options FROM part"""


@query("pdf_fields", SQL_FIELDS.format(text="p_name", odd="= 1"))
def pdf_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form fields of four kinds with their values and options."""
    return _values(pdf_table(_parts(spark, sf_dir), "fields"))


@query("pdf_fill_forms", SQL_FIELDS.format(text="concat('new ', p_name)", odd="<> 1"))
def pdf_fill_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same forms with every field set anew through an edit log."""
    part = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 20).cast("string").alias("path"), F.col("p_partkey").alias("seq"), "p_name", "p_brand", "p_size")
    odd, kind = F.col("p_size") % 2 == 1, F.col("seq") % 4
    action = F.when(kind == 0, "set_text").when(kind == 2, "set_choice").otherwise("set_state")
    value = F.when(kind == 0, F.concat(F.lit("new "), "p_name")).when(kind == 1, F.when(odd, "Off").otherwise("On")).when(kind == 2, F.when(odd, "other").otherwise(F.col("p_brand"))).otherwise(F.when(odd, "K0").otherwise("K1"))
    log = part.select("path", "seq", action.alias("action"), F.to_json(F.struct(F.concat(F.lit("f"), "seq").alias("name"), value.alias("value"))).alias("arguments"))
    return _values(pdf_table(editing.edit_files(_parts(spark, sf_dir), log).where("error IS NULL"), "fields"))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a conversation; each page says which turn it is."""
    return M.files(_turns(spark, sf_dir), lambda r: M.classic(M.paged(M.stream(M.simple_text(f"{r['conv_id']}/{x['turn']}")) for x in r["rows"])), "conv_id")


@query("pdf_edit_pages", """WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
placed AS (SELECT conv_id, turn, CASE WHEN k = 0 THEN n - 1 ELSE k - 1 END AS k, n FROM n)
SELECT conv_id, CAST(k + 1 AS BIGINT) AS page, concat(conv_id, '/', turn) AS text, CAST(CASE WHEN k = 0 THEN 90 ELSE 0 END AS INT) AS rotate FROM placed
UNION ALL SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '', CAST(0 AS INT) FROM n""")
def pdf_edit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edit log: the first page goes last, a blank one comes first, the next is turned; a deletion is undone."""
    files = _numbered(spark, sf_dir)
    size = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("path")).count()
    steps = [("move", F.to_json(F.struct(F.lit(0).alias("origin"), (F.col("count") - 1).alias("target")))), ("insert_blank", F.lit('{"at": 0}')), ("rotate", F.lit(json.dumps({"at": 1, "delta": -270}))), ("delete", F.lit('{"at": 0}')), ("undo", F.lit("{}"))]
    log = size.select("path", F.inline(F.array(*(F.struct(F.lit(k).alias("seq"), F.lit(a).alias("action"), x.alias("arguments")) for k, (a, x) in enumerate(steps)))))
    edited = editing.edit_files(files, log).where("error IS NULL")
    turns = pdf_table(edited, "pages").select(F.col("doc").cast("long").alias("conv_id"), F.col("page").cast("long").alias("page"), "rotate")
    return _texts(edited).join(turns, ["conv_id", "page"])


@query("pdf_assemble", """WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
size AS (SELECT DISTINCT conv_id, n FROM n)
SELECT a.conv_id, CAST(b.k AS BIGINT) AS page, concat(b.conv_id, '/', b.turn) AS text FROM size a JOIN n b ON b.conv_id = a.conv_id + 1 WHERE a.conv_id % 2 = 0
UNION ALL SELECT a.conv_id, CAST(coalesce(o.n, 0) AS BIGINT), concat(a.conv_id, '/', n.turn) FROM size a JOIN n ON n.conv_id = a.conv_id AND n.k = 0 LEFT JOIN size o ON o.conv_id = a.conv_id + 1 WHERE a.conv_id % 2 = 0""")
def pdf_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New files: all pages of the file of the next number, if there is one, then the first page of a file of even number."""
    known = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    even = known.where("conv_id % 2 = 0")
    after = even.select(F.col("conv_id").alias("target"), (F.col("conv_id") + 1).alias("conv_id")).join(known, "conv_id").select(F.col("target").cast("string"), F.lit(0).alias("seq"), F.col("conv_id").cast("string").alias("path"), F.lit(None).cast("int").alias("page"))
    own = even.select(F.col("conv_id").cast("string").alias("target"), F.lit(1).alias("seq"), F.col("conv_id").cast("string").alias("path"), F.lit(0).alias("page"))
    return _texts(editing.assemble_files(_numbered(spark, sf_dir), after.union(own)).where("error IS NULL"))


@query("pdf_optimise", SQL_TURNS.replace("conversations", "conversations WHERE turn >= 0"))
def pdf_optimise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with revisions and objects that nothing reaches, rewritten: pages stay, every file gets smaller."""

    def make(row: dict[str, Any]) -> bytes:
        data = M.classic(M.paged(M.stream(M.simple_text("old")) for _ in row["rows"]) | {5000: M.stream(b"x" * 9000)})
        return M.revised(data, {11 + 2 * k: M.stream(M.simple_text(x["text"])) for k, x in enumerate(row["rows"])})

    files = M.files(_turns(spark, sf_dir, _ascii()), make, "conv_id")
    smaller = editing.optimise_files(files).where("error IS NULL")
    lengths = files.select("path", F.octet_length("content").alias("before"))
    return _texts(smaller.join(lengths, "path").where(F.octet_length("content") < F.col("before")))


@query("pdf_mark_up", """SELECT conv_id, CAST(k AS BIGINT) AS idx, subtype, round(x0, 3) AS x0, red FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES (0, 'Highlight', 72.0::DOUBLE, 1.0::DOUBLE), (1, 'Underline', 82.0::DOUBLE, 0.25::DOUBLE), (2, 'FreeText', 5.0::DOUBLE, NULL::DOUBLE)) AS v(k, subtype, x0, red)""")
def pdf_mark_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks added, restyled, moved and removed through an edit log."""
    steps = [
        ("highlight", {"at": 0, "rect": [100, 712, 72, 700]}),
        ("strikeout", {"at": 0, "rect": [72, 700, 90, 712]}),
        ("underline", {"at": 0, "rect": [72, 700, 90, 712]}),
        ("free_text", {"at": 0, "rect": [5, 5, 200, 25], "text": "note"}),
        ("remove_annotation", {"at": 0, "index": 1}),
        ("move_annotation", {"at": 0, "index": 1, "rect": [82, 700, 100, 712]}),
        ("restyle", {"at": 0, "index": 1, "color": [0.25, 0, 0], "opacity": 0.5}),
    ]
    paths = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("path")).distinct()
    log = paths.select("path", F.inline(F.array(*(F.struct(F.lit(k).alias("seq"), F.lit(a).alias("action"), F.lit(json.dumps(x)).alias("arguments")) for k, (a, x) in enumerate(steps)))))
    found = pdf_table(editing.edit_files(_numbered(spark, sf_dir), log).where("error IS NULL"), "annotations")
    return found.select(F.col("doc").cast("long").alias("conv_id"), F.col("idx").cast("long").alias("idx"), "subtype", F.round(F.get("rect", F.lit(0)), 3).alias("x0"), F.get("color", F.lit(0)).alias("red"))


@query("pdf_images", """SELECT p_partkey, md5(concat(repeat(printf('%02X%02X%02X80', p_size, (p_size * 3) % 256, 200 - p_size), 3), repeat(printf('%02X%02X%02XFF', p_size, (p_size * 3) % 256, 200 - p_size), 3))) AS pixels, CAST(3 AS INT) AS width, CAST(2 AS INT) AS height FROM part""")
def pdf_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of three columns and two rows with a mask, as RGBA samples."""

    def make(row: dict[str, Any]) -> bytes:
        size = row["p_size"]
        pixel = bytes([size, size * 3 % 256, 200 - size])
        objects = M.paged([M.stream(b"q 30 0 0 20 0 0 cm /Im Do Q")])
        objects[2] = objects[2].replace(b"/Resources <<", b"/Resources << /XObject << /Im 5 0 R >>")
        objects[5] = M.stream(zlib.compress(pixel * 6), "/Subtype /Image /Width 3 /Height 2 /BitsPerComponent 8 /ColorSpace /DeviceRGB /Filter /FlateDecode /SMask 6 0 R")
        objects[6] = M.stream(b"\x80\xff", "/Subtype /Image /Width 1 /Height 2 /BitsPerComponent 8 /ColorSpace /DeviceGray")
        return M.classic(objects)

    found = pdf_table(M.files(_parts_table(spark, sf_dir), make, "p_partkey"), "images")
    return found.select(F.col("doc").cast("long").alias("p_partkey"), F.md5(F.hex("rgba")).alias("pixels"), "width", "height")


@query("pdf_jpeg", """SELECT p_partkey, md5(repeat(printf('%02X%02X%02XFF', 40 + p_size, 40 + p_size, 40 + p_size), 10 * (9 + p_partkey % 12))) AS pixels, CAST(9 + p_partkey % 12 AS INT) AS width FROM part""")
def pdf_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey images as JPEG files behind another filter, some with restart markers."""

    def make(row: dict[str, Any]) -> bytes:
        wide = 9 + row["p_partkey"] % 12
        data = M.jpeg(np.full((10, wide, 1), 40 + row["p_size"], np.uint8), restart=row["p_partkey"] % 2)
        objects = M.paged([M.stream(b"q 30 0 0 20 0 0 cm /Im Do Q")])
        objects[2] = objects[2].replace(b"/Resources <<", b"/Resources << /XObject << /Im 5 0 R >>")
        objects[5] = M.stream(base64.a85encode(data) + b"~>", f"/Subtype /Image /Width {wide} /Height 10 /BitsPerComponent 8 /ColorSpace /DeviceGray /Filter [/ASCII85Decode /DCTDecode]")
        return M.classic(objects)

    found = pdf_table(M.files(_parts_table(spark, sf_dir), make, "p_partkey"), "images")
    return found.select(F.col("doc").cast("long").alias("p_partkey"), F.md5(F.hex("rgba")).alias("pixels"), "width")


@query("pdf_raster", """SELECT p_partkey, CAST(CASE WHEN p_size % 2 = 0 THEN 60 ELSE 40 END AS INT) AS width, CAST((3 + p_size % 20) * (2 + p_partkey % 13) AS BIGINT) AS red, CAST(10 * 4 AS BIGINT) AS line, CAST(CASE WHEN p_partkey % 3 = 0 THEN 12 ELSE 24 END AS BIGINT) AS green FROM part""")
def pdf_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of pages: a red box, a line four points wide, a green image of which a clip may hide half; some turned."""

    def make(row: dict[str, Any]) -> bytes:
        clip = "30 0 3 30 re W n " if row["p_partkey"] % 3 == 0 else ""
        shown = f"1 0 0 rg 2 20 {3 + row['p_size'] % 20} {2 + row['p_partkey'] % 13} re f 0.2 0.8 0.4 RG 4 w 5 10 m 15 10 l S q {clip}6 0 0 4 30 2 cm /Im Do Q"
        objects = M.paged([M.stream(shown.encode())], page=lambda _: "/Rotate 90" if row["p_size"] % 2 else "")
        objects[2] = objects[2].replace(b"/Resources <<", b"/Resources << /XObject << /Im 5 0 R >>").replace(b"612 792", b"60 40")
        objects[5] = M.stream(b"\x00\xff\x00", "/Subtype /Image /Width 1 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceRGB")
        return M.classic(objects)

    found = pdf_table(M.files(_parts_table(spark, sf_dir), make, "p_partkey"), "raster")
    counts = {name: F.regexp_count(F.hex("rgba"), F.lit(f"{color}FF")).cast("long").alias(name) for name, color in (("red", "FF0000"), ("line", "33CC66"), ("green", "00FF00"))}
    return found.select(F.col("doc").cast("long").alias("p_partkey"), "width", *counts.values())


@query("pdf_path_geometry", """WITH r AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS s FROM part), p AS (SELECT * FROM (VALUES (0, 'm'), (1, 'l'), (2, 'c'), (3, 'h')) AS v(k, op))
SELECT p_partkey, CAST(k AS INT) AS k, op, CAST(CASE k WHEN 2 THEN 6 WHEN 3 THEN 0 ELSE 2 END AS INT) AS n, CASE k WHEN 0 THEN 2 * s WHEN 1 THEN 2 * s + 20 WHEN 2 THEN 2 * s + 20 END AS x, CAST(p_partkey % 3 AS INT) AS clips FROM r, p""")
def pdf_path_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of paths as rows, and how many clips hold them."""

    def make(row: dict[str, Any]) -> bytes:
        size = row["p_size"]
        shown = f"2 0 0 2 0 0 cm {'0 0 99 99 re W* n ' * (row['p_partkey'] % 3)}{size} 1 m {size + 10} 1 l {size + 12} 5 {size} 9 v h B*"
        return M.classic(M.paged([M.stream(shown.encode())]))

    found = pdf_table(M.files(_parts_table(spark, sf_dir), make, "p_partkey"), "paths").where("paint = 'fs' AND rule = 'evenodd'")
    rows = found.select("doc", "clips", F.posexplode("segments").alias("k", "s"))
    return rows.select(F.col("doc").cast("long").alias("p_partkey"), "k", "s.op", F.size("s.at").alias("n"), F.get("s.at", F.lit(0)).alias("x"), "clips")


@query("pdf_page_info", """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS page, concat(conv_id, '/', turn) AS text, CAST(length(concat(conv_id, '/', turn)) AS BIGINT) AS glyphs FROM conversations""")
def pdf_page_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page shows, in numbers and text."""
    return pdf_table(_numbered(spark, sf_dir), "summary").select(F.col("doc").cast("long").alias("conv_id"), F.col("page").cast("long").alias("page"), "text", "glyphs")


@query("pdf_image_page", """SELECT n_nationkey, CAST(8 + n_nationkey AS INT) AS width, md5(repeat(printf('%02X%02X%02XFF', 90 + n_nationkey, 90 + n_nationkey, 90 + n_nationkey), 8 * (8 + n_nationkey))) AS pixels, CAST(2 AS BIGINT) AS pages FROM nation""")
def pdf_image_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JPEG file put in as a page of its own by an edit log."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").cast("string").alias("path"))
    files = M.files(nation, lambda r: M.classic(M.paged([M.stream(b"")])), "n_nationkey")
    pictures = M.files(nation, lambda r: M.jpeg(np.full((8, 8 + r["n_nationkey"], 1), 90 + r["n_nationkey"], np.uint8)), "n_nationkey")
    log = pictures.select("path", F.lit(0).alias("seq"), F.lit("insert_image").alias("action"), F.to_json(F.struct(F.lit(0).alias("at"), F.hex("content").alias("jpeg"))).alias("arguments"))
    edited = editing.edit_files(files, log).where("error IS NULL")
    pages = pdf_table(edited, "pages").groupBy("doc").agg(F.count("*").alias("pages"))
    found = pdf_table(edited, "images").where("page = 0").join(pages, "doc")
    return found.select(F.col("doc").cast("int").alias("n_nationkey"), "width", F.md5(F.hex("rgba")).alias("pixels"), "pages")


@query("pdf_many_tables", """SELECT conv_id, CAST(n AS INT) AS n_pages, CAST(n AS BIGINT) AS pages, CAST(2 * n + 3 AS BIGINT) AS objects, text FROM (SELECT conv_id, count(*) AS n, string_agg(concat(conv_id, '/', turn), ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)""")
def pdf_many_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four tables of files that are opened once."""
    found = pdf_tables(_numbered(spark, sf_dir), ("files", "pages", "objects", "page_text"))
    texts = found["page_text"].groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), " ").alias("text"))
    counts = [found[n].groupBy("doc").agg(F.count("*").alias(n)) for n in ("pages", "objects")]
    rows = found["files"].join(counts[0], "doc").join(counts[1], "doc").join(texts, "doc")
    return rows.select(F.col("doc").cast("long").alias("conv_id"), "n_pages", "pages", "objects", "text")


@query("pdf_raster_text", r"""SELECT n_nationkey, CAST(64 * length(regexp_replace(n_name, '[^AEIOU]', '', 'g')) + 128 * length(regexp_replace(n_name, '[^RNT]', '', 'g')) AS BIGINT) AS black FROM nation""")
def pdf_raster_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in a font of squares: one for A, E, I, O and U, two for R, N and T, nothing for the rest; in simple and composite fonts."""
    square = M.shape([(0, 0, True), (0, 800, True), (800, 800, True), (800, 0, True)])
    glyphs = [b"", square, M.assembled((1, 0, 0), (1, 0, 1000))]
    which = {ord(c): 1 for c in "AEIOU"} | {ord(c): 2 for c in "RNT"}
    font = zlib.compress(M.truetype(glyphs, which))

    def make(row: dict[str, Any]) -> bytes:
        name = row["n_name"]
        if row["n_nationkey"] % 2:
            codes, objects = M.identity_font("".join(sorted(set(name))))
            shown = b"".join(b"%04X" % which.get(ord(c), 0) for c in name)
            objects[4] = b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Made /CIDToGIDMap /Identity /DW 1000 /FontDescriptor 6 0 R >>"
            base, text = "", b"<" + shown + b">"
        else:
            objects, base, text = {}, f"/Type /Font /Subtype /TrueType /BaseFont /Made /Encoding /WinAnsiEncoding /FirstChar 32 /Widths [{'1000 ' * 96}] /FontDescriptor 6 0 R", M.literal(name.encode())
        pages = M.paged([M.stream(b"BT /F1 10 Tf 5 10 Td " + text + b" Tj ET")], base)
        return M.classic(pages | objects | {6: b"<< /Type /FontDescriptor /FontName /Made /FontFile2 7 0 R >>", 7: M.stream(font, "/Filter /FlateDecode")})

    found = pdf_table(M.files(table(spark, sf_dir, "nation").select("n_nationkey", F.upper("n_name").alias("n_name")), make, "n_nationkey"), "raster")
    return found.select(F.col("doc").cast("int").alias("n_nationkey"), F.regexp_count(F.hex("rgba"), F.lit("000000FF")).cast("long").alias("black"))


@query("pdf_free_text", """SELECT n_nationkey, n_name AS text, round(12.0::DOUBLE, 4) AS x, round(5 + greatest(n_nationkey + 2 - 12, 1) / 2 + 2.4::DOUBLE, 4) AS y FROM nation""")
def pdf_free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text put into boxes of several heights: where its line stands."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_nationkey").cast("string").alias("path"))
    files = M.files(nation, lambda r: M.classic(M.paged([M.stream(b"")])), "n_nationkey")
    box = F.array(F.lit(10.0), F.lit(5.0), F.lit(200.0), 7.0 + F.col("n_nationkey"))
    log = nation.select("path", F.lit(0).alias("seq"), F.lit("free_text").alias("action"), F.to_json(F.struct(F.lit(0).alias("at"), box.alias("rect"), F.col("n_name").alias("text"))).alias("arguments"))
    glyphs = pdf_table(editing.edit_files(files, log).where("error IS NULL"), "glyphs", include_annotations=True)
    shown = glyphs.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("seq", "uni", "m"))).alias("g"))
    text = F.array_join(F.transform("g", lambda x: x["uni"]), "")
    return shown.select(F.col("doc").cast("int").alias("n_nationkey"), text.alias("text"), F.round(F.col("g")[0]["m"]["e"], 4).alias("x"), F.round(F.col("g")[0]["m"]["f"], 4).alias("y"))
