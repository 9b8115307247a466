"""Files that arrive in a folder, parsed once each into growing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.sources.pdf.tables import SCHEMAS, pdf_tables

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """The PDF files of a folder as a stream; each is seen once, however often it is listed."""
    source = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true")
    return source.option("maxFilesPerTrigger", files_a_batch).load(folder)


def ingest(files: DataFrame, target: str, checkpoint: str, names: tuple[str, ...] = ("files", "pages", "page_text"), once: bool = True) -> StreamingQuery:
    """Write the named tables (see SCHEMAS) of arriving files below `target`.

    A micro-batch replaces its own partition, so one that runs again after a failure writes nothing twice.
    """
    unknown = set(names) - set(SCHEMAS)
    if unknown:
        raise ValueError(f"unknown tables {sorted(unknown)}")

    def write(batch: DataFrame, number: int) -> None:
        for name, table in pdf_tables(batch, names).items():
            table.write.mode("overwrite").parquet(f"{target.rstrip('/')}/{name}/batch={number}")

    stream = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
