"""Exact substring dedup: longest previous factors over the suffixes that can match.

A string of LENGTH bytes repeats only if its anchor repeats. The anchor of a string is the GRAM-byte piece
in it with the least hash, the leftmost of equals, so it depends on the string alone and both places of a
repeated string have the same anchor at the same offset. Neighbouring strings mostly share an anchor: a text
becomes runs of strings, one for each anchor, about one in 75 bytes.

1. Anchors are counted over all texts; runs whose anchor occurs once hold no repeated string.
2. Runs equal as a whole, by two hashes of 64 bits, form a class; a class of two or more is repeated throughout.
   So a group of copies, however large, is counted where it lies and goes on as one row a class.
3. Where the runs of an anchor differ, one run of each class goes to the anchor's bucket. There the suffixes are
   sorted by prefix doubling to LENGTH bytes (that re-sorts only unfinished groups), ties by text and place.
   Previous and next smaller places in suffix order, with the common prefixes between, give each suffix its
   longest previous factor, up to LENGTH; one of LENGTH is a later copy, and where the factor lies is a place that
   has a later copy.
4. Anchors with more than HOT classes are not gathered: their strings are hashed, dealt out and counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import small, stage, trimmed

LENGTH, GRAM = 200, 51
#: Classes of one anchor that one task may hold, about 300 bytes each.
HOT = 100_000
#: Bytes that a task sorts at once, and strings of a text that are cut into runs at once.
CHUNK, PIECE = 1 << 19, 1 << 19

_random = np.random.default_rng(20240301)
_BYTE = _random.integers(0, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_random.integers(1 << 62, 1 << 63, dtype=np.uint64)) | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, from running minima inside blocks."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(data: bytes) -> list[np.ndarray]:
    """(anchor hash, hash of the whole run, first string, number of strings, anchor's offset) of each run.

    Strings are taken PIECE at a time, so memory does not follow the text; a run that a piece cuts is two runs.
    """
    found = []
    for begin in range(0, max(len(data) - LENGTH + 1, 1), PIECE):
        anchor, whole, first, count, offset = _runs(data[begin : begin + PIECE + LENGTH - 1])
        found.append((anchor, whole, first + np.int32(begin), count, offset))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _runs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    if n < LENGTH:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.int32),) * 3
    up, down = _powers_to(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[np.frombuffer(data, np.uint8)] * up[:n], out=prefix[1:])
    grams = _mix((prefix[GRAM:] - prefix[:-GRAM]) * down[: n + 1 - GRAM])
    order = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    owner = (sliding_min(order, LENGTH - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    count = np.diff(np.append(first, len(owner)))
    place = owner[first]
    end = first + count - 1 + LENGTH
    whole = (prefix[end] - prefix[first]) * down[first]
    whole = _mix(whole + _mix((place - first).astype(np.uint64) * np.uint64(1 << 20) + count.astype(np.uint64)))
    return grams[place].view(np.int64), whole.view(np.int64), first.astype(np.int32), count.astype(np.int32), (place - first).astype(np.int32)


@trimmed
def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ("anchor", "whole", "first", "count", "offset"), (pa.int64(),) * 2 + (pa.int32(),) * 3
    for batch in batches:
        found = [runs((text.as_py() or "").encode("utf-8", "surrogatepass")) for text in batch.column("text")]
        columns = [pa.array([row[k] for row in found], pa.list_(kind)) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tie"), *columns], ["id", "tie", *names])


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of every suffix by its first `length` bytes (missing ones count as zeros): equal strings have equal ranks, and
    ranks are in suffix order. Prefix doubling from 8 bytes on; only groups that still tie are sorted again."""
    n = len(data)
    wide, key = np.concatenate((data, np.zeros(8, np.uint8))), np.zeros(n, np.uint64)
    for k in range(8):
        key <<= np.uint64(8)
        key |= wide[k : k + n]
    order = np.argsort(key, kind="stable").astype(np.int32)
    fresh = np.ones(n, bool)
    key = key[order]
    fresh[1:] = key[1:] != key[:-1]
    del key, wide
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n, dtype=np.int32), np.int32(0)))
    done = 8
    while done < length and n:
        step = min(done, length - done)
        at = np.flatnonzero(~(fresh & np.append(fresh[1:], True))).astype(np.int32)
        if not len(at):
            break
        who = order[at]
        pair = rank[who].astype(np.int64) << 32  # group, then the rank of what follows
        pair += np.where(who < n - step, rank[np.minimum(who, n - step - 1) + step] + 1, 0) if step < n else 0
        again = np.argsort(pair, kind="stable")
        who, pair = who[again], pair[again]
        del again
        order[at] = who
        split = np.ones(len(at), bool)
        split[1:] = pair[1:] != pair[:-1]
        fresh[at] = split
        rank[who] = np.maximum.accumulate(np.where(split, at, np.int32(0)))
        done += step
    return rank


def common_prefixes(data: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """Longest common prefix, `most` bytes at most, of the suffix at each place with the one before in the list; 0 for the first."""
    wide = np.concatenate((data, np.zeros(8 + most, np.uint8)))
    words = np.zeros(len(data) + most, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | wide[k : k + len(words)]
    out = np.zeros(len(at), np.int32)
    open_ = np.arange(1, len(at))
    for done in range(0, most, 8):
        apart = words[at[open_] + done] ^ words[at[open_ - 1] + done]
        differ = apart != 0
        part = apart[differ]
        out[open_[differ]] = done + sum((part < np.uint64(1 << (64 - 8 * k))).astype(np.int32) for k in range(1, 8))
        open_ = open_[~differ]
    out[open_] = most
    return np.minimum(out, most)


def longest_previous(order: np.ndarray, lcp: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous factors: for each suffix the longest prefix that it shares with one of a smaller place, and which
    (-1 for none).

    order lists suffixes in suffix order, lcp holds the common prefix of each with the one before. The longest
    is shared with the nearest suffix of smaller place on one side or the other; both are found for all at once
    by jumping over suffixes of larger place, the least common prefix on the way being what remains shared.
    """
    p, n = place[order], len(order)
    best, source = np.zeros(n, np.int32), np.full(n, -1)
    for way in (1, -1):
        here = p[::way]
        to = np.arange(n) - 1
        shared = lcp.copy() if way == 1 else np.concatenate((lcp[:1], lcp[:0:-1]))
        going = np.flatnonzero((to >= 0) & (here[to] > here))
        while len(going):
            via = to[going]
            shared[going] = np.minimum(shared[going], shared[via])
            to[going] = to[via]
            going = going[(to[going] >= 0) & (here[to[going]] > here[going])]
        shared[to < 0] = 0
        shared, to = shared[::way], (to if way == 1 else np.where(to < 0, -1, n - 1 - to))[::way]
        more = shared > best
        best[more], source[more] = shared[more], order[to[more]]
    longest, earlier = np.empty(n, np.int32), np.empty(n, np.int64)
    longest[order], earlier[order] = best, source
    return longest, earlier


def _repeated(chunk: list[tuple], keep_first: bool) -> dict[str, list]:
    """Spans of the strings of a bucket whose longest previous factor is LENGTH; without keep_first also of those
    that are such a factor of a later one."""
    out: dict[str, list] = {"id": [], "tie": [], "start": [], "end": []}
    if len(chunk) < 2:
        return out
    data = np.frombuffer(b"".join(x[4] for x in chunk), np.uint8)
    counts = np.array([x[3] for x in chunk])
    offsets = np.cumsum([0] + [len(x[4]) for x in chunk[:-1]])
    row = np.repeat(np.arange(len(chunk)), counts)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = offsets[row] + inner
    # places in order of (text, position); runs of a text do not overlap
    by_text = sorted(range(len(chunk)), key=lambda k: (chunk[k][0], chunk[k][1], chunk[k][2]))
    nth = np.empty(len(chunk), np.int64)
    nth[by_text] = np.cumsum(counts[by_text]) - counts[by_text]
    place = nth[row] + inner
    order = np.lexsort((place, suffix_ranks(data, LENGTH)[at]))
    lcp = common_prefixes(data, at[order], LENGTH)
    del data, at
    longest, earlier = longest_previous(order, lcp, place)
    marked = longest >= LENGTH
    if not keep_first:
        marked[earlier[marked]] = True
    hit = np.flatnonzero(marked)
    if len(hit):
        begins = np.concatenate(([True], (np.diff(hit) != 1) | (np.diff(row[hit]) != 0)))
        ends = np.append(begins[1:], True)
        for a, b in zip(hit[begins], hit[ends], strict=True):
            x = chunk[row[a]]
            out["id"].append(x[0])
            out["tie"].append(x[1])
            out["start"].append(x[2] + int(inner[a]))
            out["end"].append(x[2] + int(inner[b]) + LENGTH)
    return out


_SPANS = pa.schema([("id", pa.int64()), ("tie", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def _sort_buckets(keep_first: bool):
    @trimmed
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: list[tuple] = []
        bucket: list[tuple] = []
        at, size, waiting = None, 0, 0
        for batch in batches:
            for anchor, *x in zip(*(batch.column(k).to_pylist() for k in ("anchor", "id", "tie", "first", "count", "data")), strict=True):
                if anchor != at:
                    chunk += bucket
                    size += waiting
                    bucket, waiting, at = [], 0, anchor
                    if size > CHUNK:
                        yield pa.RecordBatch.from_pydict(_repeated(chunk, keep_first), _SPANS)
                        chunk, size = [], 0
                bucket.append(tuple(x))
                waiting += len(x[4])
        yield pa.RecordBatch.from_pydict(_repeated(chunk + bucket, keep_first), _SPANS)

    return sort


@trimmed
def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each wanted run of a text, with its bytes."""
    for batch in batches:
        for key, tie, text, want in zip(*(batch.column(k) for k in ("id", "tie", "text", "want")), strict=True):
            data, want = (text.as_py() or "").encode("utf-8", "surrogatepass"), want.as_py()
            cut = [data[w["first"] : w["first"] + w["count"] - 1 + LENGTH] for w in want]
            for k in range(0, len(want), 10_000):
                part = want[k : k + 10_000]
                yield pa.RecordBatch.from_pydict({"anchor": pa.array([w["anchor"] for w in part], pa.int64()), "hot": pa.array([w["hot"] for w in part], pa.bool_()), "id": pa.array([key.as_py()] * len(part), pa.int64()), "tie": pa.array([tie.as_py()] * len(part), pa.int64()), "first": pa.array([w["first"] for w in part], pa.int32()), "count": pa.array([w["count"] for w in part], pa.int32()), "offset": pa.array([w["offset"] for w in part], pa.int32()), "data": pa.array(cut[k : k + 10_000], pa.binary())})


def _hash_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for anchor, key, tie, first, count, offset, data in zip(*(batch.column(k).to_pylist() for k in ("anchor", "id", "tie", "first", "count", "offset", "data")), strict=True):
            hashes = [xxhash.xxh3_128_digest(data[k : k + LENGTH]) for k in range(count)]
            yield pa.RecordBatch.from_pydict({"anchor": pa.array([anchor] * count, pa.int64()), "back": pa.array([offset - k for k in range(count)], pa.int32()), "string": pa.array(hashes, pa.binary()), "id": pa.array([key] * count, pa.int64()), "tie": pa.array([tie] * count, pa.int64()), "start": pa.array(range(first, first + count), pa.int32())})


def find_spans(rows: DataFrame, keep_first: bool, hot: int = HOT) -> DataFrame:
    """Spans (id, tie, start, end), possibly overlapping, of the repeated strings in rows (id, tie, text)."""
    found = stage(rows.where(F.octet_length("text") >= LENGTH).mapInArrow(_find_runs, "id long, tie long, anchor array<long>, whole array<long>, first array<int>, count array<int>, offset array<int>"), "sub-runs")
    flat = found.select("id", "tie", F.explode(F.arrays_zip("anchor", "whole", "first", "count", "offset")).alias("r")).select("id", "tie", "r.*")
    anchors = flat.select("anchor", "whole").groupBy("anchor").agg(F.count("*").alias("n"), F.min("whole").alias("lo"), F.max("whole").alias("hi")).where("n > 1")
    anchors = stage(anchors.select("anchor", (F.col("lo") != F.col("hi")).alias("mixed")), "sub-anchors")
    places = stage(flat.join(small(anchors), "anchor"), "sub-places")
    spot = F.struct("id", "tie", "first")
    classes = stage(places.groupBy("anchor", "whole").agg(F.count("*").alias("n"), F.min(F.struct("id", "tie", "first", "count", "offset")).alias("least"), F.first("mixed").alias("mixed")), "sub-classes")
    whole = places.join(classes.where("n > 1").select("anchor", "whole", "least"), ["anchor", "whole"])
    if keep_first:
        whole = whole.where(spot != F.struct("least.id", "least.tie", "least.first"))
    whole = whole.select("id", "tie", F.col("first").alias("start"), (F.col("first") + F.col("count") - 1 + LENGTH).alias("end"))

    mixed = classes.where("mixed").select("anchor", "n", "least.*")
    sizes = mixed.groupBy("anchor").agg(F.count("*").alias("classes"), F.count_if(F.col("n") == 1).alias("single"))
    sizes = sizes if keep_first else sizes.where("single > 0")
    mixed = mixed.join(sizes.select("anchor", (F.col("classes") > hot).alias("hot")), "anchor")
    wanted = stage(mixed.groupBy("id", "tie").agg(F.collect_list(F.struct("anchor", "first", "count", "offset", "hot")).alias("want")), "sub-wanted")
    cut = rows.join(small(wanted), ["id", "tie"]).mapInArrow(_cut_contexts, "anchor long, hot boolean, id long, tie long, first int, count int, offset int, data binary")
    cut = cut.dropDuplicates(["anchor", "id", "tie", "first"]) if keep_first else cut
    any_hot = sizes.where(F.col("classes") > hot).limit(1).count() > 0
    cut = stage(cut, "sub-cut") if any_hot else cut
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = cut.where("NOT hot").select("anchor", "id", "tie", "first", "count", "data").repartition(parts, "anchor").sortWithinPartitions("anchor")
    spans = whole.union(buckets.mapInArrow(_sort_buckets(keep_first), "id long, tie long, start int, end int"))
    if any_hot:
        strings = stage(cut.where("hot").mapInArrow(_hash_strings, "anchor long, back int, string binary, id long, tie long, start int"), "sub-strings")
        where = F.struct("id", "tie", "start")
        repeated = strings.groupBy("anchor", "back", "string").agg(F.min(where).alias("least"), F.max(where).alias("most")).where("least <> most").select("anchor", "back", "string", "least")
        again = strings.join(repeated, ["anchor", "back", "string"])
        again = again.where(where != F.col("least")) if keep_first else again
        spans = spans.union(again.select("id", "tie", "start", (F.col("start") + LENGTH).alias("end")))
    return spans


def merge(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans."""
    out: list[list[int]] = []
    for x in sorted((x["start"], x["end"]) for x in spans or ()):
        if out and x[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x[1])
        else:
            out.append(list(x))
    return [tuple(x) for x in out]


_RUNS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


@trimmed
def _merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans overlap, about one every 75 bytes; merged, they are as few as the removed runs, which is what gets joined to texts."""
    for batch in batches:
        runs = [[{"start": a, "end": b} for a, b in merge(raw.as_py())] for raw in batch.column("raw")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tie"), pa.array(runs, _RUNS)], ["id", "tie", "raw"])


def _cut_out(as_text: bool):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, raw in zip(batch.column("_text"), batch.column("_raw"), strict=True):
                data, gone = (text.as_py() or "").encode("utf-8", "surrogatepass"), merge(raw.as_py())
                sizes.append(len(data))
                spans.append([{"start": a, "end": b} for a, b in gone])
                edges = zip([0] + [b for _, b in gone], [a for a, _ in gone] + [len(data)], strict=True)
                pieces = [data[a:b] for a, b in edges] if gone else [data]
                kept.append("".join(x.decode("utf-8", "ignore") for x in pieces) if as_text else b"".join(pieces))
            rest = [c for c in batch.schema.names if c not in ("_text", "_raw")]
            columns = [*(batch.column(c) for c in rest), pa.array(sizes, pa.int64()), pa.array(spans, _RUNS), pa.array(kept, pa.string() if as_text else pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*rest, "n_bytes", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, keep_first: bool = True, carry: tuple[str, ...] = (), as_text: bool = False, hot: int = HOT) -> DataFrame:
    """Remove the bytes of texts (UTF-8) that strings of 200 bytes repeat, whole corpus against whole corpus.

    keep_first: the earliest place, by (doc_id, offset), null doc_ids last, keeps its bytes; otherwise every
    place of a repeated string goes. Strings are judged on the input, overlapping repeats count, and none
    crosses texts. Returns doc_id, `carry`, n_bytes, spans (maximal removed runs of original offsets) and
    kept (the other bytes; as_text: a string, without characters that a span cuts). Null texts are empty. Rows that repeat a doc_id and text repeat each other,
    and none of them comes first. Other columns are ignored; an empty table gives an empty result.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id")
    rows = docs.select(key, F.xxhash64("text", "doc_id").alias("tie"), "text", "doc_id", *carry)
    spans = find_spans(rows.select("id", "tie", "text"), keep_first, hot).groupBy("id", "tie").agg(F.collect_set(F.struct("start", "end")).alias("raw"))
    marked = stage(spans.mapInArrow(_merge_spans, "id long, tie long, raw array<struct<start:int,end:int>>"), "sub-marked")
    joined = rows.join(small(marked), ["id", "tie"], "left").select("doc_id", *carry, F.col("text").alias("_text"), F.col("raw").alias("_raw"))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *carry))
    return joined.mapInArrow(_cut_out(as_text), f"{schema}, n_bytes long, spans array<struct<start:int,end:int>>, kept {'string' if as_text else 'binary'}")


#: All strings of 200 bytes, as 400 hexadecimal digits: for tables of some thousand documents. Every place goes.
ORACLE = r"""
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
places AS (SELECT doc_id, unnest(range(0, greatest(CAST(length(h) / 2 AS BIGINT) - 199, 0))) AS p FROM texts),
strings AS (SELECT doc_id, p, hash(substr(h, CAST(2 * p + 1 AS BIGINT), 400)) AS k FROM places JOIN texts USING (doc_id)),
repeated AS (SELECT doc_id, p FROM strings WHERE k IN (SELECT k FROM strings GROUP BY k HAVING count(*) > 1)),
marked AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM repeated),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 200 AS b FROM runs GROUP BY doc_id, run),
pieces AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM spans),
cut AS (SELECT doc_id, count(*) AS n, sum(b - a) AS gone, max(b) AS last, string_agg(substr(h, CAST(2 * from_ + 1 AS BIGINT), CAST(2 * (a - from_) AS BIGINT)), '' ORDER BY a) AS kept FROM pieces JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN cut.doc_id IS NULL THEN h ELSE kept || substr(h, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256
FROM texts LEFT JOIN cut USING (doc_id)
"""
