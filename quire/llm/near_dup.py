"""Near-duplicate documents: an LSH forest of MinHash signatures, links confirmed on full shingle sets.

Every distinct shingle set gets a signature of 128 minima. Tree t of the forest is the sorted order of the
signatures read from value 4 t on; two sets are near in it if they share a long prefix. A row of an order is
a label of the first LEAST_DEPTH values and one of the next four, so sorting rows sorts prefixes, and the
longest common prefix of any two rows can be read off their labels. Orders are sorted by a range shuffle, in
which a region of any size is cut over as many tasks as it fills. A region is the rows that share LEAST_DEPTH
values. Links are sought from the deepest neighbours upwards, and a region is left at the depth at which all
of its sets are connected, so large groups of copies cost a few comparisons a member and never all pairs:

1. equal sets collapse to one node;
2. each node is compared with its neighbour of the longest common prefix in any order, and with the first node
   of its regions;
3. in regions that still hold several components, each node is compared with the nearest one of another
   component, again that of the longest common prefix in any order;
4. regions that hold several components even then have reached the least depth. There the signatures of nodes
   outside the largest component meet all those of other components; where none comes near the threshold the
   region is closed, and the rest is compared in full. Only marks and links leave a task, no pairs.

Two sets of similarity 0.75 share no region with a probability of 5e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import components, small, stage, trimmed

SHINGLE = 5
PERCENT = 75
#: Trees, the least depth of a common prefix, and the values of a prefix beyond it.
TREES, LEAST_DEPTH, MORE = 32, 4, 4
VALUES = TREES * LEAST_DEPTH
#: Signatures, and shingles of sets, that a task holds as one of two sides of a region.
SIGNATURES, REGION = 2_000, 500_000
#: Members whose sets a task compares with one leader.
BLOCK = 256
#: Estimates are 5 standard deviations below the threshold before they rule a link out.
LEAST_ESTIMATE = PERCENT / 100 - 5 * (PERCENT / 100 * (1 - PERCENT / 100) / VALUES) ** 0.5

_random = np.random.default_rng(20240229)
_A = _random.integers(1 << 31, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _random.integers(0, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32)
_PLACE = _random.integers(1 << 62, 1 << 63, SHINGLE + 1, dtype=np.uint64) | np.uint64(1)
_TREE = _random.integers(0, 1 << 63, TREES, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles, A-Z in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(w) for w in words], np.uint64)
    width = min(SHINGLE, len(h))
    total = np.full(len(h) - width + 1, width, np.uint64) * _PLACE[SHINGLE]
    for k in range(width):
        total += mix64(h[k : len(h) - width + 1 + k] + _PLACE[k])
    return np.unique(mix64(total))


def signature(items: np.ndarray) -> np.ndarray:
    x = (items >> np.uint64(32)).astype(np.uint32)
    least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for begin in range(0, len(x), 2048):
        part = x[begin : begin + 2048]
        np.minimum(least, (_A[:, None] * part + _B[:, None]).min(axis=1), out=least)
    # sixteen well mixed bits of each tell minima apart as well as all of them do
    return ((least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.uint16)


def tree_labels(sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each signature and tree the label of the first LEAST_DEPTH values and that of the next MORE.

    The first is a hash, equal if all of those values are; the second holds 16 bits of each value, first values first.
    """
    values = sigs.reshape(len(sigs), VALUES).astype(np.uint64)
    rotated = values[:, (np.arange(TREES)[:, None] * LEAST_DEPTH + np.arange(LEAST_DEPTH + MORE)) % VALUES]
    key, deep = np.tile(_TREE, (len(sigs), 1)), np.zeros((len(sigs), TREES), np.uint64)
    for k in range(LEAST_DEPTH):
        key = mix64(key + rotated[:, :, k])
    for k in range(LEAST_DEPTH, LEAST_DEPTH + MORE):
        deep = (deep << np.uint64(16)) | (mix64(rotated[:, :, k]) >> np.uint64(48))
    return key.view(np.int64), (deep ^ np.uint64(1 << 63)).view(np.int64)


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Depth of the longest common prefix of rows of one region, from their second labels."""
    apart = (a ^ b).view(np.uint64)
    return LEAST_DEPTH + sum((apart < np.uint64(1 << (64 - 16 * k))).astype(np.int32) for k in range(1, MORE)) + (apart == 0)


@trimmed
def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, digests, sigs = [], [], []
        for text in batch.column("text"):
            items = shingles(text.as_py())
            n.append(len(items))
            digests.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
            sigs.append(signature(items).tobytes() if len(items) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "tie", "n_shingles", "digest", "sig"])


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, n_shingles, digest of the set, signature) of each row; tie is a hash of text and id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text", "doc_id").alias("tie"), "text").mapInArrow(_describe, "doc_id long, tie long, n_shingles long, digest binary, sig binary")


@trimmed
def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of all orders, one a tree and node."""
    for batch in batches:
        sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, VALUES)
        key, deep = tree_labels(sigs)
        node = np.repeat(batch.column("node").to_numpy(), TREES)
        yield pa.RecordBatch.from_pydict({"key": pa.array(key.ravel()), "deep": pa.array(deep.ravel()), "node": pa.array(node)})


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(k).to_numpy(zero_copy_only=False) for k in names]


@trimmed
def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sorted orders that share a region with the row before or after, and their neighbour before with its depth.

    The first and last rows of a task always stay, as their region may go on in the next task.
    """
    names, last = ("key", "deep", "node", "near", "depth", "stays"), None
    for batch in batches:
        key, deep, node = _columns(batch, "key", "deep", "node")
        if last:
            key, deep, node = (np.concatenate((old, new)) for old, new in zip(last, (key, deep, node)))
        same = key[1:] == key[:-1]
        near, depth = np.concatenate((node[:1], node[:-1])), np.zeros(len(key), np.int32)
        depth[1:] = np.where(same, common_prefix(deep[1:], deep[:-1]), 0)
        stays = depth > 0
        stays[:-1] |= same
        near[0], depth[0], stays[0] = (last[3][0], last[4][0], last[5][0] or stays[0]) if last else (node[0], 0, True)
        rows = key, deep, node, near, depth, stays
        yield pa.RecordBatch.from_pydict({k: x[:-1][stays[:-1]] for k, x in zip(names[:-1], rows)})
        last = [x[-1:] for x in rows]
    if last:
        yield pa.RecordBatch.from_pydict(dict(zip(names[:-1], last)))


@trimmed
def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows of sorted orders the nearest row before of another component in the region, and the other way round at the border."""
    held = None
    for batch in batches:
        key, deep, node, root = (np.concatenate((old, new)) for old, new in zip(held or [np.empty(0, np.int64)] * 4, _columns(batch, "key", "deep", "node", "root"), strict=True))
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (root[1:] != root[:-1])))
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
        other = np.maximum(start - 1, 0)
        has = np.flatnonzero((start > 0) & (key[other] == key))
        has = has[has >= (len(held[0]) if held else 0)]
        border = has[fresh[has]]
        a, b = np.concatenate((has, other[border])), np.concatenate((other[has], border))
        yield pa.RecordBatch.from_pydict({"node": node[a], "other": node[b], "depth": common_prefix(deep[a], deep[b])})
        keep = [other[-1], -1] if start[-1] > 0 and key[other[-1]] == key[-1] else [-1]
        held = [x[keep] for x in (key, deep, node, root)]


@trimmed
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (leader, salt, leader first): compare each member with the leader before it."""
    leader, items = None, np.empty(0, np.uint64)
    for batch in batches:
        a_out, b_out = [], []
        columns = [batch.column(k).to_pylist() for k in ("leader", "salt", "id", "digest")]
        for a, salt, b, wanted, text in zip(*columns, batch.column("text"), strict=True):
            own = shingles(text.as_py())
            if xxhash.xxh3_128_digest(own.tobytes()) != wanted:
                continue  # another text under the same doc_id
            if a == b:
                leader, items = (a, salt), own
            elif leader == (a, salt):
                few, many = sorted((len(own), len(items)))
                if 100 * few < PERCENT * many:
                    continue
                common = len(own) + len(items) - len(np.union1d(own, items))
                if 100 * common >= PERCENT * (few + many - common):
                    a_out.append(a)
                    b_out.append(b)
        yield pa.RecordBatch.from_pydict({"u": pa.array(a_out, pa.int64()), "v": pa.array(b_out, pa.int64())})


def verify(docs: DataFrame, pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The staged pairs (a, b) of nodes whose full sets are similar enough, as (u, v).

    A leader's pairs are cut into blocks of about BLOCK members; a text goes to every block that needs it.
    """
    salts = F.ceil(F.col("n") / BLOCK).cast("long")
    sized = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "a", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("b"), salts), F.lit(0)).cast("int"))
    sized = sized.select("a", "b", "salt")
    route = sized.select(F.col("a").alias("leader"), "salt", F.col("b").alias("id")).union(sized.select(F.col("a").alias("leader"), "salt", F.col("a").alias("id")).distinct())
    route = small(stage(route.join(reps.select(F.col("node").alias("id"), "rep", "digest"), "id"), "near-route", True))
    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(route, "rep")
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    rows = rows.repartition(int(parts), "leader", "salt").sortWithinPartitions("leader", "salt", F.col("id") != F.col("leader"), "id")
    return stage(rows.select("leader", "salt", "id", "digest", "text").mapInArrow(_verify, "u long, v long").distinct(), "near-links", True)


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """The rows of each part of a region, sorted by (key, i, j)."""
    held: dict[str, list] = {}
    at = None
    for batch in batches:
        names = [c for c in batch.schema.names if c not in ("i", "j")]
        for i, j, *row in zip(*(batch.column(k).to_pylist() for k in ("i", "j", *names)), strict=True):
            if at != (row[0], i, j):
                if held:
                    yield held
                held, at = {c: [] for c in names}, (row[0], i, j)
            for values, value in zip(held.values(), row, strict=True):
                values.append(value)
    if held:
        yield held


def _meetings(held: dict[str, list]) -> Iterator[tuple[int, np.ndarray]]:
    """Each visitor of a part with the owners of other components that it meets, so that a pair meets once."""
    node, root, largest, visits = (np.array(held[k]) for k in ("node", "root", "largest", "visits"))
    own = np.flatnonzero(~visits)
    for v in np.flatnonzero(visits):
        yield v, own[(root[own] != root[v]) & (largest[own] | (node[own] < node[v]))]


def _signatures(held: dict[str, list]) -> tuple[np.ndarray, int]:
    """The signatures of a part, and the number of its tree."""
    sig = np.frombuffer(b"".join(held["sig"]), np.uint16).reshape(-1, VALUES)
    return sig, int(np.flatnonzero(tree_labels(sig[:1])[0][0] == held["key"][0])[0])


def _likely(sig: np.ndarray, tree: int, at: int, rest: np.ndarray) -> np.ndarray:
    """Which of the rest may be similar enough, of those that meet in no earlier tree."""
    same = (sig[rest] == sig[at]).reshape(len(rest), TREES, LEAST_DEPTH)
    return rest[(same.all(axis=2).argmax(axis=1) == tree) & (same.mean(axis=(1, 2)) >= LEAST_ESTIMATE)]


@trimmed
def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes that may be similar enough to one of another component in their region, by signatures alone."""
    for held in _regions(batches):
        sig, tree = _signatures(held)
        hit = np.zeros(len(sig), bool)
        for v, rest in _meetings(held):
            for begin in range(0, len(rest), 2048):
                likely = _likely(sig, tree, v, rest[begin : begin + 2048])
                hit[likely] = True
                hit[v] |= len(likely) > 0
        node = np.unique(np.array(held["node"])[hit])
        yield pa.RecordBatch.from_pydict({"key": pa.array([held["key"][0]] * len(node), pa.int64()), "node": pa.array(node, pa.int64())})


@trimmed
def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links between components inside each region, as few as connect them, from full sets.

    Sets joined by a link found here are one component.
    """
    for held in _regions(batches):
        node, root = np.array(held["node"]), np.array(held["root"])
        sig, tree = _signatures(held)
        sets = [shingles(text) for text in held["text"]]
        true = np.array([xxhash.xxh3_128_digest(x.tobytes()) == d for x, d in zip(sets, held["digest"], strict=True)])
        sizes = np.array([len(x) for x in sets])
        flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
        starts = np.cumsum(sizes) - sizes
        marks = np.zeros(flat.max(initial=0) + 1, bool)
        u, v = [], []
        for i, rest in _meetings(held):
            rest = rest[(root[rest] != root[i]) & true[rest] & true[i]]
            few, many = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
            rest = rest[100 * few >= PERCENT * many]
            for begin in range(0, len(rest), 2048):
                part = rest[begin : begin + 2048]
                part = _likely(sig, tree, i, part[root[part] != root[i]])
                if not len(part):
                    continue
                marks[flat[starts[i] : starts[i] + sizes[i]]] = True
                common = np.array([np.count_nonzero(marks[flat[starts[j] : starts[j] + sizes[j]]]) for j in part])
                marks[flat[starts[i] : starts[i] + sizes[i]]] = False
                for j in part[100 * common >= PERCENT * (sizes[part] + sizes[i] - common)]:
                    if root[j] != root[i]:
                        u.append(node[i])
                        v.append(node[j])
                        root[root == root[j]] = root[i]
        yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def mixed_rows(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Staged rows (key, deep, node, root) of the regions that hold several components."""
    labelled = members.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("key", "deep", "node", F.coalesce("root", "node").alias("root"))
    mixed = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    return stage(labelled.join(mixed, "key"), "near-mixed", True)


def nearest_across(mixed: DataFrame, tried: DataFrame) -> DataFrame:
    """For each node of a mixed region the nearest one of another component in any order, if untried, as pairs (a, b)."""
    parts = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "deep", "node"]
    found = mixed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_across, "node long, other long, depth int")
    found = found.withColumns({"a": F.least("node", "other"), "b": F.greatest("node", "other")}).join(tried, ["a", "b"], "left_anti")
    best = found.groupBy("node").agg(F.max_by(F.struct("a", "b"), F.struct("depth", -F.col("other"))).alias("pair"))
    return stage(best.select("pair.*").distinct(), "near-pairs", True)


def deal(mixed: DataFrame, weight: Column, most: int) -> DataFrame:
    """Rows of mixed regions dealt to parts (i, j) of about `most` weight on either side.

    All rows of a region own a place i, and those outside its largest component also visit all places in parts j:
    a region that is one component but for a few nodes costs as many rows as it has, and no square.
    """
    counted = mixed.withColumn("_w", weight).groupBy("key", "root").agg(F.sum("_w").alias("_w"))
    sizes = counted.groupBy("key").agg(F.max_by("root", F.struct("_w", -F.col("root"))).alias("_top"), F.ceil(F.sum("_w") / most).cast("int").alias("_own"), F.greatest(F.lit(1), F.ceil((F.sum("_w") - F.max("_w")) / most)).cast("int").alias("_visit"))
    rows = mixed.join(small(stage(sizes, "near-sizes", True)), "key").withColumn("largest", F.col("root") == F.col("_top")).drop("_top")
    place, part = F.pmod(F.xxhash64("node"), F.col("_own")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("_visit")).cast("int")
    owners = rows.select("*", F.lit(False).alias("visits"), place.alias("i"), F.explode(F.sequence(F.lit(0), F.col("_visit") - 1)).alias("j"))
    visitors = rows.where("NOT largest").select("*", F.lit(True).alias("visits"), F.explode(F.sequence(F.lit(0), F.col("_own") - 1)).alias("i"), part.alias("j")).select(owners.columns)
    return owners.unionByName(visitors).drop("_own", "_visit")


def rest_across(docs: DataFrame, mixed: DataFrame, facts: DataFrame) -> DataFrame:
    """The links (u, v) between components that are still missing."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = mixed.select("key", "node", "root")
    met = deal(rows, F.lit(1), SIGNATURES).join(facts.select("node", "sig"), "node")
    met = met.select("key", "i", "j", "node", "root", "largest", "visits", "sig").repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    marked = stage(met.mapInArrow(_mark, "key long, node long").distinct(), "near-marked", True)
    rows = stage(rows.join(marked, ["key", "node"]).join(facts, "node"), "near-rest", True)
    wanted = small(stage(rows.select("rep").distinct(), "near-wanted", True))
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted, "rep", "left_semi")
    full = texts.join(deal(rows, F.col("n_shingles"), REGION), "rep").select("key", "i", "j", "node", "root", "largest", "visits", "sig", "digest", "text")
    return stage(full.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInArrow(_rest, "u long, v long").distinct(), "near-links", True)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, n_shingles, component_id, kept) of every row of docs (doc_id, text).

    Two rows are linked if 100 * intersection >= 75 * union of their shingle sets; component_id is the
    smallest doc_id reachable. Null, empty and blank texts have no set and are linked with nothing. Rows
    with a null doc_id have no name to be reached by: component_id null, kept true. Rows that repeat a
    doc_id and text have the same result; of several texts under one doc_id each is judged by its own set.
    Other columns of docs are ignored; an empty table gives an empty result.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    described = stage(describe(docs).withColumn("row", F.monotonically_increasing_id()), "near-sets")
    named = described.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    reps = named.groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("digest", F.col("first.doc_id").alias("rep"), "first.row")
    # a node is named by its smallest doc_id; where several sets have the same, all but one by a hash
    owner = reps.groupBy("rep").agg(F.min("digest").alias("_own"))
    name = F.when(F.col("digest") == F.col("_own"), F.col("rep")).otherwise(F.xxhash64("digest").bitwiseOR(F.lit(-(1 << 63))))
    reps = stage(reps.join(owner, "rep").select("digest", "rep", "row", name.alias("node")), "near-reps", True)
    facts = described.select("row", "digest", "n_shingles", "sig").join(small(reps.select("row", "rep", "node")), "row").select("node", "rep", "digest", "n_shingles", "sig")
    order = ["key", "deep", "node"]
    forest = facts.select("node", "sig").mapInArrow(_grow, "key long, deep long, node long")
    members = stage(forest.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_neighbours, "key long, deep long, node long, near long, depth int"), "near-forest")
    deepest = members.where("depth > 0").groupBy("node").agg(F.max_by("near", F.struct("depth", -F.col("near"))).alias("near"))
    leaders = members.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader")
    tops = members.join(leaders, "key").groupBy("node").agg(F.min("leader").alias("near")).where("near < node")
    first = stage(deepest.union(tops).select(F.least("node", "near").alias("a"), F.greatest("node", "near").alias("b")).distinct(), "near-pairs", True)
    links = verify(docs, first, reps)
    roots = components(links, "near-cc")
    members = members.select(*order)
    mixed = mixed_rows(members, roots)
    pairs = nearest_across(mixed, first)
    if pairs.limit(1).count():
        links = links.union(verify(docs, pairs, reps))
        roots = components(links, "near-cc")
        mixed = mixed_rows(mixed.select(*order), roots)
    new = rest_across(docs, mixed, facts)
    if new.limit(1).count():
        roots = components(links.union(new), "near-cc")
    rooted = reps.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = stage(rooted.join(smallest, "root").select("digest", "component_id"), "near-classes", True)
    out = described.select("doc_id", "tie", "n_shingles", "digest").join(classes, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "tie", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that stay: the smallest doc_id of each component, repeated rows once.

    A null doc_id is a name of its own for each text, a hash from 2^62 on, so that copies among such rows, and
    of named ones, go too; blank texts without a doc_id are linked with nothing and stay.
    """
    columns, given = docs.columns, F.col("doc_id")
    made = F.when(F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"), F.xxhash64("text").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62))
    docs = docs.withColumn("_given", given).withColumn("doc_id", F.coalesce(given.cast("long"), made))
    return _one_of_each(docs).withColumn("doc_id", F.col("_given")).select(*columns)


def _one_of_each(docs: DataFrame) -> DataFrame:
    found = stage(near_duplicates(docs), "near-found")
    tie = F.xxhash64("text", F.col("doc_id").cast("long"))
    gone = small(stage(found.where("NOT kept").select(F.col("tie").alias("_gone")).distinct(), "near-gone"))
    rows = docs.join(gone, tie == F.col("_gone"), "left_anti")
    again = stage(found.where("doc_id IS NOT NULL AND kept").groupBy("tie").count().where("count > 1").select(F.col("tie").alias("_again")), "near-again")
    if not again.limit(1).count():
        return rows
    again = small(again)
    return rows.join(again, tie == F.col("_again"), "left_anti").union(rows.join(again, tie == F.col("_again"), "left_semi").dropDuplicates(["doc_id", "text"]))


#: All pairs that share a shingle, and what can be reached over links: for tables of some thousand documents.
ORACLE = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM texts),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y WHERE 100 * c >= 75 * (len(p.s) + len(q.s) - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT reached.doc_id, edges.y FROM reached JOIN edges ON edges.x = reached.other)
SELECT sets.doc_id, CAST(any_value(len(s)) AS BIGINT) AS n_shingles, min(other) AS component_id, sets.doc_id = min(other) AS kept
FROM sets JOIN reached ON reached.doc_id = sets.doc_id GROUP BY sets.doc_id
"""
