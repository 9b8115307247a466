"""Edits of whole collections: a log of actions applied to files, and files assembled from pages of others."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.pdf.cos import Name, PdfError
from quire.sources.pdf.document import Document
from quire.sources.pdf.write import Session, assemble

#: Actions of an edit log; their arguments are the keys of a JSON object.
ACTIONS: dict[str, Callable[..., Any]] = {
    "insert_blank": Session.insert_blank,
    "insert_image": lambda s, at, jpeg: s.insert_image(at, bytes.fromhex(jpeg)),
    "delete": Session.delete,
    "move": Session.move,
    "rotate": Session.rotate,
    "highlight": lambda s, at, rect, color=(1, 1, 0): s.highlight(at, rect, color),
    "underline": lambda s, at, rect, color=(0, 0, 0): s.highlight(at, rect, color, "Underline"),
    "strikeout": lambda s, at, rect, color=(1, 0, 0): s.highlight(at, rect, color, "StrikeOut"),
    "free_text": Session.free_text,
    "replace_text": lambda s, at, rect, text, size=12.0: s.free_text(at, rect, text, size, True),
    "remove_annotation": Session.remove_annotation,
    "restyle": Session.restyle,
    "move_annotation": Session.move_annotation,
    "set_text": lambda s, name, value: s.set_field(name, value.encode()),
    "set_choice": lambda s, name, value: s.set_field(name, value.encode()),
    "set_state": lambda s, name, value: s.set_field(name, Name(value)),
    "undo": Session.undo,
    "redo": Session.redo,
}
_OUT = pa.schema([("path", pa.string()), ("content", pa.binary()), ("error", pa.struct([("code", pa.string()), ("detail", pa.string())]))])
_DDL = "path string, content binary, error struct<code:string,detail:string>"


def _row(path: str | None, make: Callable[[], bytes]) -> pa.RecordBatch:
    """A result, or the error that takes its place: one bad file never ends a job."""
    try:
        row = {"path": path, "content": make(), "error": None}
    except PdfError as error:
        row = {"path": path, "content": None, "error": {"code": error.code, "detail": error.detail}}
    except (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError) as error:
        row = {"path": path, "content": None, "error": {"code": "Malformed", "detail": f"{type(error).__name__}: {error}"}}
    return pa.RecordBatch.from_pylist([row], _OUT)


def edited(content: bytes, log: list[tuple[str, str | None]]) -> bytes:
    """Content with the actions (name, JSON arguments) applied in turn and appended as one revision."""
    session = Session(content)
    for action, arguments in log:
        if action not in ACTIONS:
            raise PdfError("UnknownAction", str(action))
        ACTIONS[action](session, **json.loads(arguments or "{}"))
    return session.save()


def edit_files(files: DataFrame, log: DataFrame) -> DataFrame:
    """(path, content, error) of files (path, content) with their log (path, seq, action, arguments) applied.

    Files without a log come back as they are; logs without a file are ignored. All of a log takes effect or, at
    an error, none of it. Actions with the same seq are taken in order of name and arguments. Null contents are
    empty and end in an error; other columns are ignored.
    """
    logs = log.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "action", F.coalesce("arguments", F.lit("{}")).alias("arguments")))).alias("log"))
    rows = files.select("path", "content").join(logs, "path", "left").select("path", "content", "log")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, steps in zip(*(batch.column(c) for c in ("path", "content", "log")), strict=True):
                data, todo = content.as_py() or b"", [(x["action"], x["arguments"]) for x in steps.as_py() or []]
                if todo:
                    yield _row(path.as_py(), lambda data=data, todo=todo: edited(data, todo))
                else:
                    yield pa.RecordBatch.from_pylist([{"path": path.as_py(), "content": data, "error": None}], _OUT)

    return rows.mapInArrow(run, _DDL)


def optimise_files(files: DataFrame) -> DataFrame:
    """(path, content, error): files rewritten with what their pages and catalog reach, earlier revisions gone."""

    def smaller(data: bytes) -> bytes:
        doc = Document(data)
        return assemble([(doc, k) for k in range(len(doc.pages()))], doc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                yield _row(path.as_py(), lambda data=content.as_py() or b"": smaller(data))

    return files.select("path", "content").mapInArrow(run, _DDL)


def assemble_files(files: DataFrame, plan: DataFrame) -> DataFrame:
    """(path, content, error) of new files: plan (target, seq, path, page) names the pages of each, in order of seq.

    It merges and splits: a null page stands for all pages of its file. A target holds its source files once each
    while it is assembled, whatever the number of pages taken; a file that is missing is an error of its target.
    """
    wanted = plan.groupBy("target", "path").agg(F.collect_list(F.struct("seq", "page")).alias("places"))
    rows = wanted.join(files.select("path", "content"), "path", "left").select("target", "path", "places", "content")

    def build(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, sources = None, []
        for batch in group:
            for row in batch.to_pylist():
                target = row["target"]
                sources.append(row)

        def make() -> bytes:
            order = []
            for row in sources:
                if row["content"] is None:
                    raise PdfError("MissingFile", str(row["path"]))
                doc = Document(row["content"])
                for place in row["places"]:
                    pages = range(len(doc.pages())) if place["page"] is None else [place["page"]]
                    order.append((place["seq"], row["path"], [(doc, k) for k in pages]))
            order.sort(key=lambda x: x[:2])
            return assemble([page for _, _, pages in order for page in pages])

        yield _row(target, make)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each target, which lie next to each other."""
        held, at = [], None
        for batch in batches:
            for k in range(batch.num_rows):
                target = batch.column("target")[k].as_py()
                if held and target != at:
                    yield from build(iter(held))
                    held = []
                at = target
                held.append(batch.slice(k, 1))
        if held:
            yield from build(iter(held))

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "target").sortWithinPartitions("target").mapInArrow(grouped, _DDL)
