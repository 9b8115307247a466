"""Tables to files: one file for each row, in any file system that all executors reach."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Files that get their names at once when a job commits.
MOVES_AT_ONCE = 64


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]] = field(default_factory=list)


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def _open(self) -> tuple[fs.FileSystem, str]:
        system, base = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)
        return system, base.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Files get names of their own at first, so tasks that run twice do not meet."""
        system, base = self._open()
        system.create_dir(base, recursive=True)
        done = Written()
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                if not name or "/" in name or name.startswith("."):
                    raise ValueError(f"not a file name: {name!r}")
                part = f"{base}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(content.as_py() or b"")
                done.moves.append((part, f"{base}/{name}"))
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = self._open()
        moves = [move for m in messages if m for move in m.moves]
        with ThreadPoolExecutor(MOVES_AT_ONCE) as pool:  # a move is a wait for the file system
            list(pool.map(lambda move: system.move(*move), moves))

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = self._open()
        for part, _name in (move for m in messages if m for move in m.moves):
            system.delete_file(part)


class FileSink(DataSource):
    """df.write.format("quire_files").option("path", folder): rows (name string, content binary) become files."""

    @classmethod
    def name(cls) -> str:
        return "quire_files"

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("versions go to new folders; nothing is overwritten")
        return _Writer(self.options["path"])


def write_files(rows: DataFrame, folder: str) -> None:
    """Write rows (name, content) as files of a folder; all of them appear after the last is written."""
    rows.sparkSession.dataSource.register(FileSink)
    rows.select(F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content")).write.format("quire_files").option("path", folder).mode("append").save()


def file_name(doc: Column, suffix: str) -> Column:
    """The last part of a path with another suffix."""
    return F.concat(F.regexp_replace(F.element_at(F.split(doc, "/"), -1), r"\.[Pp][Dd][Ff]$", ""), F.lit(suffix))


def text_files(pages: DataFrame, doc: str = "doc", page: str = "page") -> DataFrame:
    """(name, content): the text of each document's pages, a form feed and a line feed between them.

    Documents of different folders whose names agree get a number, in order of their paths.
    """
    whole = pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(page, F.coalesce("text", F.lit("")).alias("text")))).alias("_pages"))
    named = whole.select(doc, file_name(F.col(doc), "").alias("_base"), F.array_join("_pages.text", "\f\n").alias("_text"))
    nth = F.row_number().over(Window.partitionBy("_base").orderBy(doc))
    return named.select(F.concat("_base", F.when(nth > 1, F.concat(F.lit("-"), nth)).otherwise(F.lit("")), F.lit(".txt")).alias("name"), F.encode("_text", "UTF-8").alias("content"))
