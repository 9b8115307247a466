"""PDF files to tables, a file at a time on the executors; a bad file becomes an error row."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.sources.pdf import images, raster
from quire.sources.pdf.cos import Name, PdfError, Ref, Stream, instructions, serialise, text_string
from quire.sources.pdf.document import Document, edges
from quire.sources.pdf.interpret import Interpreter, origins, text_of
from quire.sources.pdf.signatures import signatures
from quire.sources.staging import shared_folder

MATRIX = "struct<a:double,b:double,c:double,d:double,e:double,f:double>"
ERROR = "error struct<code:string,detail:string>"
SCHEMAS = {
    "files": f"doc string, length bigint, n_objects int, n_pages int, next_free int, revisions int, rebuilt boolean, info map<string,string>, {ERROR}",
    "xref": f"doc string, section_ord int, num int, gen int, kind string, offset bigint, idx int, {ERROR}",
    "trailer": f"doc string, section_ord int, key string, value string, {ERROR}",
    "objects": f"doc string, num int, gen int, kind string, is_stream boolean, raw_len bigint, value string, refs array<struct<key_path:string,dst:int>>, {ERROR}",
    "edges": f"doc string, src int, key_path string, dst int, {ERROR}",
    "pages": f"doc string, page int, obj_num int, media_box array<double>, rotate int, {ERROR}",
    "instructions": f"doc string, page int, seq bigint, op string, operands string, {ERROR}",
    "glyphs": f"doc string, page int, seq bigint, from_annot boolean, font string, code int, uni string, m {MATRIX}, advance_is_estimated boolean, {ERROR}",
    "page_text": f"doc string, page int, text string, {ERROR}",
    "runs": f"doc string, page int, runs array<struct<text:string,xs:array<double>,y:double,d:double>>, {ERROR}",
    "items": f"doc string, page int, seq bigint, kind string, from_annot boolean, paint string, box array<double>, width int, height int, {ERROR}",
    "paths": f"doc string, page int, seq bigint, paint string, rule string, fill array<double>, stroke array<double>, width double, clips int, segments array<struct<op:string,at:array<double>>>, {ERROR}",
    "raster": f"doc string, page int, width int, height int, rgba binary, {ERROR}",
    "images": f"doc string, page int, seq bigint, width int, height int, rgba binary, {ERROR}",
    "summary": f"doc string, page int, paths bigint, glyphs bigint, images bigint, any_estimated boolean, text string, ignored map<string,bigint>, {ERROR}",
    "outline": f"doc string, node int, parent int, depth int, ord int, title string, page int, {ERROR}",
    "annotations": f"doc string, page int, idx int, obj_num int, subtype string, rect array<double>, color array<double>, hidden boolean, {ERROR}",
    "fields": f"doc string, obj_num int, kind string, name string, rect array<double>, value string, options array<struct<obj_num:int,label:string,rect:array<double>,selected:boolean>>, {ERROR}",
    "signatures": f"doc string, field string, signer string, reason string, location string, signed_at_raw string, byte_range array<bigint>, status string, signer_cn string, covers_whole_file boolean, {ERROR}",
}


def read_files(spark: SparkSession, path: str, max_length: int | None = None) -> DataFrame:
    """path, modificationTime, length and content of PDF files; the length filter reaches the scan."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return files if max_length is None else files.where(F.col("length") <= max_length)


def _text(value: Any) -> str | None:
    return text_string(value) if isinstance(value, bytes) else None if value is None else str(value)


def _rect(doc: Document, value: Any) -> list[float] | None:
    out = [doc.get(x) for x in doc.get(value) or []]
    return [float(x) for x in out] if len(out) >= 4 and all(isinstance(x, int | float) for x in out) else None


def _files(doc: Document, **_: Any) -> Iterator[dict]:
    info = doc.get(doc.trailer.get("Info"))
    info = {k: text_string(v) for k, x in info.items() if isinstance(v := doc.get(x), bytes)} if isinstance(info, dict) else {}
    yield {"length": len(doc.data), "n_objects": len(doc.xref), "n_pages": len(doc.pages()), "next_free": doc.next_free, "revisions": len(doc.trailers), "rebuilt": doc.rebuilt, "info": info}


def _xref(doc: Document, **_: Any) -> Iterator[dict]:
    for order, num, gen, kind, a, b in doc.entries:
        yield {"section_ord": order, "num": num, "gen": gen, "kind": kind, "offset": a, "idx": b if kind == "compressed" else None}


def _trailer(doc: Document, **_: Any) -> Iterator[dict]:
    for order, section in enumerate(doc.trailers):
        for key in sorted(section):
            yield {"section_ord": order, "key": key, "value": serialise(section[key]).decode("latin-1")}


def _objects(doc: Document, **_: Any) -> Iterator[dict]:
    for num in sorted(doc.xref):
        value = doc.resolve(num)
        body = value.dict if isinstance(value, Stream) else value
        yield {"num": num, "gen": doc.xref[num][2], "kind": str(body.get("Type", "")) if isinstance(body, dict) else type(body).__name__, "is_stream": isinstance(value, Stream), "raw_len": len(value.raw) if isinstance(value, Stream) else None, "value": serialise(body).decode("latin-1"), "refs": [{"key_path": path, "dst": dst} for path, dst in edges(body)]}


def _edges(doc: Document, **_: Any) -> Iterator[dict]:
    for num in sorted(doc.xref):
        for path, dst in edges(doc.resolve(num)):
            yield {"src": num, "key_path": path, "dst": dst}


def _pages(doc: Document, **_: Any) -> Iterator[dict]:
    for p in doc.pages():
        yield {"page": p.index, "obj_num": p.ref.num, "media_box": p.media_box, "rotate": p.rotate}


def _instructions(doc: Document, pages: list[int] | None = None, **_: Any) -> Iterator[dict]:
    for p in doc.pages():
        if pages is None or p.index in pages:
            try:
                for seq, (op, operands) in enumerate(instructions(doc.content(p))):
                    yield {"page": p.index, "seq": seq, "op": op, "operands": serialise(operands).decode("latin-1")}
            except PdfError as error:
                yield {"page": p.index, "error": {"code": error.code, "detail": error.detail}}


def _each_page(doc: Document, include_annotations: bool, pages: list[int] | None) -> Iterator[tuple[int, list[dict]]]:
    runner = Interpreter(doc)
    for p in doc.pages():
        if pages is None or p.index in pages:
            try:
                yield p.index, runner.page(p, include_annotations)
            except PdfError as error:
                yield p.index, [{"kind": "error", "error": {"code": error.code, "detail": error.detail}}]


def _glyphs(doc: Document, include_annotations: bool = False, pages: list[int] | None = None) -> Iterator[dict]:
    for page, items in _each_page(doc, include_annotations, pages):
        for seq, x in enumerate(items):
            if x["kind"] == "error":
                yield {"page": page, "error": x["error"]}
            elif x["kind"] == "glyph":
                yield {"page": page, "seq": seq, "from_annot": x["annot"], "font": x["font"], "code": x["code"], "uni": x["uni"], "m": dict(zip("abcdef", x["m"], strict=True)), "advance_is_estimated": x["estimated"]}


def _page_text(doc: Document, include_annotations: bool = False, pages: list[int] | None = None) -> Iterator[dict]:
    runner = Interpreter(doc)
    for p in doc.pages():
        if pages is None or p.index in pages:
            try:
                yield {"page": p.index, "text": text_of(runner.runs(p, include_annotations))}
            except PdfError as error:
                yield {"page": p.index, "error": {"code": error.code, "detail": error.detail}}


def _runs(doc: Document, include_annotations: bool = False, pages: list[int] | None = None) -> Iterator[dict]:
    """A row a page: its glyphs as runs on one height, an x for each character (those of a ligature share one)."""
    runner = Interpreter(doc)
    for p in doc.pages():
        if pages is None or p.index in pages:
            try:
                out: list[dict] = []
                for x in runner.runs(p, include_annotations):
                    if x["kind"] == "run":
                        level, (xs, ys) = x["along"][1] == 0, (o.tolist() for o in origins(x))
                        shown = [(u, a, b) for u, a, b in zip(x["texts"], xs, ys, strict=True) if u]
                        for part in [shown] if level else [[g] for g in shown]:
                            if part:
                                out.append({"text": "".join(u for u, _, _ in part), "xs": [a for u, a, _ in part for _ in u], "y": part[0][2], "d": x["m"][3]})
                yield {"page": p.index, "runs": out}
            except PdfError as error:
                yield {"page": p.index, "error": {"code": error.code, "detail": error.detail}}


def _glyph_batch(doc: str, page: int, items: list[dict], target: pa.Schema) -> pa.RecordBatch | None:
    """The rows of _glyphs() for one page, column by column."""
    runs, at, seq = [], [], 0
    for x in items:
        n = len(x["codes"]) if x["kind"] == "run" else 1
        if x["kind"] == "run":
            runs.append(x)
            at.append(np.arange(seq, seq + n))
        seq += n
    if not runs:
        return None
    sizes = [len(x["codes"]) for x in runs]
    n = sum(sizes)
    places = [np.concatenate(o) for o in zip(*map(origins, runs), strict=True)]
    matrix = [np.repeat([x["m"][k] for x in runs], sizes) for k in range(4)] + places
    which = pa.array(np.repeat(np.arange(len(runs)), sizes))
    columns = {
        "doc": pa.array([doc]).take(pa.array(np.zeros(n, np.int64))),
        "page": pa.array(np.full(n, page, np.int32)),
        "seq": pa.array(np.concatenate(at)),
        "from_annot": pa.array([x["annot"] for x in runs]).take(which),
        "font": pa.array([x["font"] for x in runs], pa.string()).take(which),
        "code": pa.array([c for x in runs for c in x["codes"]], pa.int32()),
        "uni": pa.array([u for x in runs for u in x["texts"]], pa.string()),
        "m": pa.StructArray.from_arrays([pa.array(v) for v in matrix], fields=list(target.field("m").type)),
        "advance_is_estimated": pa.array([x["estimated"] for x in runs]).take(which),
        "error": pa.nulls(n, target.field("error").type),
    }
    return pa.RecordBatch.from_arrays([columns[f.name] for f in target], schema=target)


def _glyph_batches(doc: str, content: bytes, password: bytes, target: pa.Schema, include_annotations: bool = False, pages: list[int] | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of rows("glyphs"), a batch a page."""

    def failed(code: str, detail: str, page: int | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"doc": doc, "page": page, "error": {"code": code, "detail": detail}}], target)

    try:
        opened = Document(content, password)
        runner = Interpreter(opened)
        for p in opened.pages():
            if pages is None or p.index in pages:
                try:
                    found = _glyph_batch(doc, p.index, runner.runs(p, include_annotations), target)
                except PdfError as error:
                    found = failed(error.code, error.detail, p.index)
                if found is not None:
                    yield found
    except PdfError as error:
        yield failed(error.code, error.detail)
    except (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError) as error:
        yield failed("Malformed", f"{type(error).__name__}: {error}")


def _items(doc: Document, include_annotations: bool = False, pages: list[int] | None = None) -> Iterator[dict]:
    for page, items in _each_page(doc, include_annotations, pages):
        for seq, x in enumerate(items):
            yield {"page": page, "seq": seq, "kind": x["kind"], "from_annot": x.get("annot"), "paint": x.get("paint"), "box": x.get("box"), "width": x.get("width"), "height": x.get("height"), "error": x.get("error")}


def _paths(doc: Document, include_annotations: bool = False, pages: list[int] | None = None) -> Iterator[dict]:
    """Paths with their geometry on the page; curves have three places, each two numbers."""
    for page, items in _each_page(doc, include_annotations, pages):
        for seq, x in enumerate(items):
            if x["kind"] == "error":
                yield {"page": page, "error": x["error"]}
            elif x["kind"] == "path":
                yield {"page": page, "seq": seq, "paint": x["paint"], "rule": x["rule"], "fill": x["fill"], "stroke": x["stroke"], "width": x["width"], "clips": x["clips"], "segments": [{"op": op, "at": [float(c) for p in places for c in p]} for op, *places in x["segments"]]}


def _raster(doc: Document, pages: list[int] | None = None, scale: float = 1.0, turn: int = 0) -> Iterator[dict]:
    for p in doc.pages():
        if pages is None or p.index in pages:
            try:
                pixels = raster.render(doc, p, scale, turn)
                yield {"page": p.index, "width": pixels.shape[1], "height": pixels.shape[0], "rgba": pixels.tobytes()}
            except PdfError as error:
                yield {"page": p.index, "error": {"code": error.code, "detail": error.detail}}


def _images(doc: Document, include_annotations: bool = False, pages: list[int] | None = None) -> Iterator[dict]:
    for page, items in _each_page(doc, include_annotations, pages):
        for seq, x in enumerate(items):
            if x["kind"] == "error":
                yield {"page": page, "error": x["error"]}
            elif x["kind"] == "image":
                row = {"page": page, "seq": seq, "width": x["width"], "height": x["height"]}
                try:
                    yield row | {"rgba": images.rgba(doc, x["stream"]).tobytes()}
                except PdfError as error:
                    yield row | {"error": {"code": error.code, "detail": error.detail}}


def _summary(doc: Document, include_annotations: bool = False, pages: list[int] | None = None) -> Iterator[dict]:
    runner = Interpreter(doc)
    for p in doc.pages():
        if pages is None or p.index in pages:
            try:
                items = runner.page(p, include_annotations)
            except PdfError as error:
                yield {"page": p.index, "error": {"code": error.code, "detail": error.detail}}
                continue
            kinds = [x["kind"] for x in items]
            yield {"page": p.index, "paths": kinds.count("path"), "glyphs": kinds.count("glyph"), "images": kinds.count("image"), "any_estimated": any(x.get("estimated") for x in items), "text": "".join(x["uni"] or "" for x in items if x["kind"] == "glyph"), "ignored": dict(runner.ignored)}


def _outline(doc: Document, **_: Any) -> Iterator[dict]:
    yield from doc.outline()


def _annotations(doc: Document, **_: Any) -> Iterator[dict]:
    for p in doc.pages():
        for idx, entry in enumerate(doc.get(p.dict.get("Annots")) or []):
            a = doc.get(entry)
            if isinstance(a, dict) and (rect := _rect(doc, a.get("Rect"))):
                color = [doc.get(x) for x in doc.get(a.get("C")) or []]
                yield {"page": p.index, "idx": idx, "obj_num": entry.num if isinstance(entry, Ref) else None, "subtype": _text(a.get("Subtype")), "rect": rect, "color": [float(x) for x in color] if len(color) == 3 else None, "hidden": bool((doc.get(a.get("F")) or 0) & 0x22)}


def _on_state(doc: Document, widget: Any) -> str | None:
    states = doc.find(widget, "AP", "N")
    return next((k for k in sorted(states) if k != "Off"), None) if isinstance(states, dict) else None


def _fields(doc: Document, **_: Any) -> Iterator[dict]:
    for ref in doc.find(doc.trailer.get("Root"), "AcroForm", "Fields") or []:
        f = doc.get(ref)
        if not isinstance(f, dict) or not isinstance(ref, Ref):
            continue
        kind, flags, rect = f.get("FT"), doc.get(f.get("Ff")) or 0, _rect(doc, f.get("Rect"))
        row = {"obj_num": ref.num, "name": _text(doc.get(f.get("T"))), "rect": rect, "value": _text(doc.get(f.get("V"))), "options": None}
        if kind == "Tx" and rect:
            yield row | {"kind": "text"}
        elif kind == "Ch" and rect and not flags & 1 << 21:
            labels = [doc.get(doc.get(o)[0]) if isinstance(doc.get(o), list) else doc.get(o) for o in doc.get(f.get("Opt")) or []]
            yield row | {"kind": "choice", "options": [{"obj_num": None, "label": _text(x), "rect": None, "selected": _text(x) == row["value"]} for x in labels]}
        elif kind == "Btn" and flags & 1 << 15 and f.get("Kids"):
            kids = [(k, doc.get(k)) for k in doc.get(f["Kids"])]
            options = [{"obj_num": k.num, "label": _on_state(doc, w), "rect": _rect(doc, w.get("Rect")), "selected": w.get("AS") is not None and str(w["AS"]) == _on_state(doc, w)} for k, w in kids if isinstance(w, dict) and isinstance(k, Ref)]
            if options:
                yield row | {"kind": "radio", "options": options}
        elif kind == "Btn" and rect and not flags & 1 << 16:
            yield row | {"kind": "checkbox", "value": "true" if f.get("AS") is not None and str(f["AS"]) == _on_state(doc, f) else "false"}


def _signatures(doc: Document, **_: Any) -> Iterator[dict]:
    yield from signatures(doc)


READERS: dict[str, Callable[..., Iterator[dict]]] = {"files": _files, "xref": _xref, "trailer": _trailer, "objects": _objects, "edges": _edges, "pages": _pages, "instructions": _instructions, "glyphs": _glyphs, "page_text": _page_text, "runs": _runs, "items": _items, "paths": _paths, "raster": _raster, "images": _images, "summary": _summary, "outline": _outline, "annotations": _annotations, "fields": _fields, "signatures": _signatures}


def _opened(name: str, doc: str, opened: Callable[[], Document], options: dict[str, Any]) -> Iterator[dict]:
    try:
        for row in READERS[name](opened(), **options):
            yield {"doc": doc, "error": None} | row
    except PdfError as error:
        yield {"doc": doc, "error": {"code": error.code, "detail": error.detail}}
    except (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError) as error:
        yield {"doc": doc, "error": {"code": "Malformed", "detail": f"{type(error).__name__}: {error}"}}


def rows(name: str, doc: str, content: bytes, password: bytes = b"", **options: Any) -> Iterator[dict]:
    """Rows of one table for one file; whatever goes wrong ends in a row with an error."""
    yield from _opened(name, doc, lambda: Document(content, password), options)


def pdf_tables(files: DataFrame, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """Several tables of files (path, content and, if there is one, password), each file opened once for all of them.

    The rows of all tables are written to the shared folder together, each in the column of its table, and read from
    there; a reader of one table scans its own column of its own part.
    """
    kinds = {n: StructType.fromDDL(SCHEMAS[n]) for n in names}
    schema = "name string, " + ", ".join(f"`{n}` {kinds[n].simpleString()}" for n in names)
    target = to_arrow_schema(StructType.fromDDL(schema))
    password = F.col("password").cast("string") if "password" in files.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, secret in zip(*(batch.column(c) for c in ("path", "content", "password")), strict=True):
                opened = functools.cache(lambda content=content, secret=secret: Document(content.as_py() or b"", (secret.as_py() or "").encode()))
                for name in names:
                    found = _opened(name, path.as_py(), opened, {})
                    while held := list(itertools.islice(found, 10_000)):
                        yield pa.RecordBatch.from_pylist([{"name": name, name: row} for row in held], target)

    path = shared_folder(files.sparkSession, "pdf-tables")
    files.select("path", "content", password.alias("password")).mapInArrow(run, schema).write.partitionBy("name").parquet(path)
    whole = files.sparkSession.read.schema(schema).parquet(path)
    return {n: whole.where(F.col("name") == n).select(f"`{n}`.*") for n in names}


#: Tables with rows of single pages, which tasks can share out; files of fewer bytes are read by one task.
PAGED, LARGE_FILE, PAGES_A_TASK = frozenset(("instructions", "glyphs", "page_text", "runs", "items", "paths", "raster", "images", "summary")), 1 << 20, 100


#: Rows are sent on in batches of about so many bytes, each row counted with its long columns and so much for the others.
BATCH_BYTES, ROW_BYTES = 2 << 20, 200
LONG: dict[str, Callable[[dict], int]] = {
    "runs": lambda row: 64 * sum(len(x["xs"]) for x in row.get("runs") or ()),
    "paths": lambda row: 200 * len(row.get("segments") or ()),
    "fields": lambda row: 200 * len(row.get("options") or ()),
    "objects": lambda row: len(row.get("value") or "") + 100 * len(row.get("refs") or ()),
} | {n: lambda row, c=c: len(row.get(c) or "") for n, c in (("trailer", "value"), ("instructions", "operands"), ("page_text", "text"), ("summary", "text"), ("raster", "rgba"), ("images", "rgba"))}


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each PAGES_A_TASK pages of a file; what cannot be opened is one range, and an error there."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            try:
                password = row.column("password")[0].as_py()
                n = len(Document(row.column("content")[0].as_py() or b"", password.encode() if isinstance(password, str) else password or b"").pages())
            except (PdfError, ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError):
                n = 0
            for first in range(0, max(n, 1), PAGES_A_TASK):
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([first], pa.int32()), pa.array([first + PAGES_A_TASK], pa.int32())], [*row.schema.names, "first_page", "end_page"])


def pdf_table(files: DataFrame, name: str, **options: Any) -> DataFrame:
    """A table (see SCHEMAS) of files (path, content and, if there are any, password and length).

    Pages of a large file are dealt to tasks by the hundred, where a table has rows of single pages.
    """
    password = F.col("password") if "password" in files.columns else F.lit(None).cast("string")
    rows = files.select("path", "content", password.alias("password"), *(["length"] if "length" in files.columns else []))
    if name not in PAGED or options.get("pages") is not None:
        return _read(rows.drop("length"), name, options)
    length = F.col("length") if "length" in files.columns else F.coalesce(F.octet_length("content"), F.lit(0))
    small, large = rows.where(length <= LARGE_FILE).drop("length"), rows.where(length > LARGE_FILE).drop("length")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in large.schema)
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = large.mapInArrow(_ranges, f"{schema}, first_page int, end_page int").repartition(parts)
    return _read(small, name, options).unionByName(_read(dealt, name, options))


def _read(files: DataFrame, name: str, options: dict[str, Any]) -> DataFrame:
    schema = SCHEMAS[name]
    target = to_arrow_schema(StructType.fromDDL(schema))
    ranged, weight = "first_page" in files.columns, LONG.get(name, lambda _: 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0  # rows of small files go together
        for batch in batches:
            for k in range(batch.num_rows):
                password = batch.column("password")[k].as_py()
                password = password.encode() if isinstance(password, str) else password or b""
                own = options | ({"pages": range(batch.column("first_page")[k].as_py(), batch.column("end_page")[k].as_py())} if ranged else {})
                if name == "glyphs":
                    yield from _glyph_batches(batch.column("path")[k].as_py(), batch.column("content")[k].as_py() or b"", password, target, **own)
                    continue
                for row in rows(name, batch.column("path")[k].as_py(), batch.column("content")[k].as_py() or b"", password, **own):
                    held.append(row)
                    size += ROW_BYTES + weight(row)
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, target)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, target)

    return files.mapInArrow(run, schema)


def flat_glyphs(glyphs: DataFrame) -> DataFrame:
    """Glyph rows in the form that the text operators take."""
    return glyphs.where("error IS NULL").select("doc", "page", "seq", "uni", F.col("m.e").alias("x"), F.col("m.f").alias("y"), F.col("m.d").alias("d"))


__all__ = ["Name", "pdf_table", "pdf_tables", "read_files", "rows"]
