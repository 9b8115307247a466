"""WARC records in seekable Zstandard bundles.

A bundle is one archive: independent Zstandard frames, each holding a few whole records, closed by a
skippable frame with a seek table, so any record can be read by decompressing one frame. Bundles are rows
(bundle, content, entries) of a table, which any store that Spark writes can hold and whose commit
survives lost executors; `export` also writes them as plain `.warc.zst` files.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import small, stage

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed values of the seekable format
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 32 << 20
#: Equal payloads of fewer bytes are all kept as responses.
MIN_REVISIT_BYTES = 100
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

BUNDLES = "bundle string, content binary, entries array<struct<page_id:bigint,frame:int,start:int,length:int>>"
RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def frames_and_table(frames: list[tuple[bytes, int]]) -> bytes:
    """Frames (compressed, raw size) followed by the seek table as a skippable frame."""
    table = b"".join(struct.pack("<II", len(data), raw) for data, raw in frames)
    body = table + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return b"".join(data for data, _ in frames) + struct.pack("<II", SKIPPABLE, len(body)) + body


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, raw size) of each frame, read from the footer alone."""
    count, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end")
    size = 12 if flags & 0x80 else 8
    begin, found, offset = len(content) - 9 - count * size, [], 0
    for k in range(count):
        packed, raw = struct.unpack_from("<II", content, begin + k * size)
        found.append((offset, packed, raw))
        offset += packed
    return found


def read_frame(content: bytes, table: list[tuple[int, int, int]], frame: int) -> bytes:
    offset, packed, raw = table[frame]
    return zstandard.ZstdDecompressor().decompress(content[offset : offset + packed], max_output_size=max(raw, 1))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, repeat: int = 0) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without."""
    name = f"<urn:page:{'null' if page_id is None else page_id}:{repeat}:{digest[:16]}>"
    block = b"" if refers_to is not None else HTTP % len(payload) + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Read one record back: its headers decide the type, its block gives the payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record length does not match its header")
    digest, url = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields.get("WARC-Target-URI")
    out = {"page_id": int(p) if (p := fields.get("X-Page-ID")) else None, "url": None if url is None else url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%"), "record_type": fields["WARC-Type"], "payload_digest": digest}
    if fields["WARC-Type"] == "revisit":
        return out | {"refers_to": int(fields["X-Refers-To-Page-ID"]), "payload_bytes": int(fields["X-Payload-Length"]), "payload": None}
    payload = block.partition(b"\r\n\r\n")[2]
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("payload does not match its digest")
    return out | {"refers_to": None, "payload_bytes": len(payload), "payload": payload}


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("bundle", pa.string()), ("content", pa.binary()), ("entries", pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("start", pa.int32()), ("length", pa.int32())])))])
    squeeze = zstandard.ZstdCompressor(level=3, write_content_size=True)
    frames: list[tuple[bytes, int]] = []
    entries: list[dict] = []
    open_records: list[bytes] = []
    held = packed = 0

    def close_frame() -> None:
        nonlocal held, packed
        if open_records:
            data = squeeze.compress(b"".join(open_records))
            frames.append((data, held))
            packed += len(data)
            open_records.clear()
            held = 0

    def close_bundle() -> pa.RecordBatch:
        nonlocal packed
        content = frames_and_table(frames)
        row = {"bundle": f"{hashlib.sha256(content).hexdigest()[:24]}.warc.zst", "content": content, "entries": list(entries)}
        frames.clear()
        entries.clear()
        packed = 0
        return pa.RecordBatch.from_pylist([row], schema)

    for batch in batches:
        for row in zip(*(batch.column(k) for k in ("page_id", "url", "html", "payload_digest", "refers_to")), strict=True):
            page_id, url, html, digest, refers_to = (x.as_py() for x in row)
            data = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, refers_to, len(entries))
            if held and held + len(data) > FRAME_BYTES:
                close_frame()
            entries.append({"page_id": page_id, "frame": len(frames), "start": held, "length": len(data)})
            open_records.append(data)
            held += len(data)
            if packed + held > BUNDLE_BYTES:
                close_frame()
                yield close_bundle()
    close_frame()
    if frames:
        yield close_bundle()


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    for batch in batches:
        for content, entries in zip(batch.column("content"), batch.column("entries"), strict=True):
            content, rows, size = content.as_py(), [], 0
            table, at, raw = seek_table(content), -1, b""
            for entry in entries.as_py():
                if entry["frame"] != at:
                    at = entry["frame"]
                    raw = read_frame(content, table, at)
                found = parse(raw[entry["start"] : entry["start"] + entry["length"]])
                if found["page_id"] != entry["page_id"]:
                    raise ValueError("the index names another record")
                rows.append(found)
                size += found["payload_bytes"]
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def plan(pages: DataFrame) -> DataFrame:
    """Pages with payload_digest and refers_to: null for responses, else the page that holds the payload.

    Of a group of equal payloads of at least 100 bytes the smallest page_id is the response; if rows repeat that
    page_id, the one with the smallest url, null last, and of equal rows one. All others revisit it, null page_ids
    too; a group without any page_id has nothing to refer to, and all of it are responses. Only digests and ids are
    grouped. Digests seen once never reach the join, so the table of groups is small and is broadcast once a count
    has proved it; beyond the bound the join shuffles and Spark splits a hot digest.
    """
    digest = F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256)
    rows = pages.select("page_id", "url", "html", digest.alias("payload_digest"))
    ids = rows.where(F.octet_length("html") >= MIN_REVISIT_BYTES).groupBy("payload_digest", "page_id").agg(F.count("*").alias("n"))
    first = ids.groupBy("payload_digest").agg(F.min("page_id").alias("first_page"), F.sum("n").alias("n"), F.min_by("n", F.col("page_id")).alias("n_first"))
    first = small(stage(first.where("n > 1 AND first_page IS NOT NULL").select("payload_digest", "first_page", "n_first"), "warc-groups"))
    joined = rows.join(first, "payload_digest", "left")
    joined = joined.withColumn("first_page", F.when(F.octet_length("html") >= MIN_REVISIT_BYTES, F.col("first_page")))
    again = (F.col("page_id") == F.col("first_page")) & (F.col("n_first") > 1)
    columns = ["page_id", "url", "html", "payload_digest", "refers_to"]
    single = joined.where(~F.coalesce(again, F.lit(False))).withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_page")), F.col("first_page")))
    if not first.where("n_first > 1").limit(1).count():
        return single.select(columns)
    # equal rows are counted, not gathered, and one of each stands for them
    kinds = joined.where(again).groupBy("page_id", "url", "payload_digest").agg(F.first("html").alias("html"), F.count("*").alias("n"))
    least = kinds.groupBy("payload_digest").agg(F.min(F.struct(F.col("url").isNull(), "url"))["url"].alias("_url"), F.lit(True).alias("_any"))
    copies = kinds.join(least, "payload_digest").withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    holds = (F.col("_k") == 1) & F.col("url").eqNullSafe(F.col("_url"))
    return single.select(columns).unionByName(copies.withColumn("refers_to", F.when(~holds, F.col("page_id"))).select(columns))


def write(pages: DataFrame) -> DataFrame:
    """Bundles of one record per page (page_id, url, html); a null html is an empty payload."""
    return plan(pages).mapInArrow(_pack, BUNDLES)


def read(bundles: DataFrame) -> DataFrame:
    """All records of bundles, through the footer and the index, checked against their digests."""
    return bundles.select("content", "entries").mapInArrow(_unpack, RECORDS)


def lookup(bundles: DataFrame, page_ids: DataFrame) -> DataFrame:
    """Where records lie: (page_id, bundle, frame, start, length) for the wanted page_ids."""
    entries = bundles.select("bundle", F.explode("entries").alias("e")).select("bundle", "e.*")
    return entries.join(page_ids.select("page_id").distinct(), "page_id")


def export(bundles: DataFrame, folder: str) -> DataFrame:
    """Write bundles as files to a folder, a path or address that the file systems of pyarrow reach from all executors.

    Names follow content, and a file takes its name only when whole, so retries agree. Returns the names.
    """

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}")
        for batch in batches:
            for name, content in zip(batch.column("bundle").to_pylist(), batch.column("content"), strict=True):
                store.create_dir(root, recursive=True)
                part = f"{root}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as file:
                    file.write(content.as_buffer())
                store.move(part, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"bundle": batch.column("bundle")})

    return bundles.mapInArrow(save, "bundle string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives to the shared folder, then read every record back from them."""
    return read(stage(write(pages), "warc"))


ORACLE = """
WITH rows AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages),
sized AS (SELECT page_id, url, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM rows),
placed AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS LAST) AS n FROM sized)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND n > 1 AND first_page IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND n > 1 THEN first_page END AS refers_to
FROM placed
"""
