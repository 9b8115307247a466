"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A bag is WIDTH neighbouring words; its features are the character 3- to 6-grams (bytes of the lower-cased
words, with word ends) hashed to BUCKETS rows of an embedding. A bag's vector is the mean of its rows and a
linear softmax scores it; a text scores as its worst bag, so a few words in a long text are not averaged
away. Embedding and softmax learn together by AdaGrad: first on whole texts, then on the worst bag of each
text under the model so far. As the softmax is linear, scoring needs one number a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import trimmed

GRAMS = (3, 4, 5, 6)
BUCKETS, DIM = 1 << 18, 8
WIDTH = 5
THRESHOLD = 0.7
#: The sample that is learnt from: at most so many labelled documents, those of least hash, none of more bytes than this.
MAX_TRAIN, MAX_TRAIN_BYTES = 9000, 1 << 20
#: Bytes that are turned into features at once.
CHUNK = 1 << 18

#: Byte classes: 0 ends a word; letters, digits and all of UTF-8's other bytes build words, A-Z as a-z.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 0 for c in range(256)], np.uint8)
_STEP = np.uint32(0x01000193)


class Features:
    """Hashed n-grams of a run of texts: buckets by place, words, and the text of each word. Only a byte and two numbers
    a word are held; n-grams are made a block of CHUNK bytes at a time."""

    def __init__(self, texts: list[str | None]):
        raw = [(text or "").encode("utf-8", "surrogatepass") for text in texts]
        self.data = _FOLD[np.frombuffer(b"\n" + b"\n".join(raw) + b"\n" + b"\n" * max(GRAMS), np.uint8)]
        self.inside = self.data != 0
        self.n = len(self.data) - max(GRAMS)
        self.starts = np.flatnonzero(self.inside[1:] & ~self.inside[:-1]) + 1
        self.ends = np.flatnonzero(self.inside[:-1] & ~self.inside[1:]) + 1
        limits = np.cumsum([1] + [len(x) + 1 for x in raw])
        self.first = np.searchsorted(self.starts, limits)  # first word of each text, and the end

    def grams(self, begin: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each width the bucket of the n-gram at places begin to end, and whether it lies within one word."""
        h, unbroken = self.data[begin:end].astype(np.uint32), np.ones(end - begin, bool)
        for width in range(2, max(GRAMS) + 1):
            h = (h * _STEP) ^ self.data[begin + width - 1 : end + width - 1]
            if width > 2:
                unbroken &= self.inside[begin + width - 2 : end + width - 2]
            if width in GRAMS:
                mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                yield (mixed >> np.uint32(14)).astype(np.int32), unbroken

    def word_sums(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Running sums over words of the features' weights and of their number."""
        at = np.append(self.starts - 1, self.ends[-1] - 1 if len(self.ends) else 0)
        out, before = np.zeros((2, len(at))), np.zeros(2)
        for begin in range(0, self.n, CHUNK):
            end = min(begin + CHUNK, self.n)
            sums = np.zeros((2, end - begin + 1))
            for bucket, ok in self.grams(begin, end):
                sums[0, 1:] += np.where(ok, weight[bucket], 0)
                sums[1, 1:] += ok
            sums = np.cumsum(sums, axis=1) + before[:, None]
            here = slice(*np.searchsorted(at, (begin, end)))
            out[:, here], before = sums[:, at[here] - begin], sums[:, -1]
        return out[0], out[1]

    def best(self, weight: np.ndarray) -> np.ndarray:
        """The highest mean of a bag in each text; -inf without words."""
        total, count = self.word_sums(weight)
        out = np.full(len(self.first) - 1, -np.inf)
        for k, (low, high) in enumerate(zip(self.first, self.first[1:], strict=False)):
            if high > low:
                width = min(WIDTH, high - low)
                t, c = total[low : high + 1], count[low : high + 1]
                out[k] = ((t[width:] - t[:-width]) / np.maximum(c[width:] - c[:-width], 1)).max()
        return out

    def worst(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the highest mean of a bag, and the bag's first and last word; -inf without words."""
        total, count = self.word_sums(weight)
        texts = len(self.first) - 1
        best, low, high = np.full(texts, -np.inf), self.first[:-1].copy(), self.first[:-1].copy()
        sizes = np.diff(self.first)
        bags = np.where(sizes > 0, np.maximum(sizes - WIDTH, 0) + 1, 0)
        owner = np.repeat(np.arange(texts), bags)
        if len(owner):
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(bags) - bags, bags)
            a = self.first[owner] + nth
            b = np.minimum(a + WIDTH, self.first[owner + 1])
            mean = (total[b] - total[a]) / np.maximum(count[b] - count[a], 1)
            order = np.lexsort((-a, mean, owner))
            last = order[np.append(np.flatnonzero(np.diff(owner[order])), len(order) - 1)]
            best[owner[last]], low[owner[last]], high[owner[last]] = mean[last], a[last], b[last]
        return best, low, high

    def bag(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, bucket) of every feature of the texts' bags, the words low to high of each."""
        has = np.flatnonzero(high > low)
        begin, end = self.starts[low[has]] - 1, self.ends[high[has] - 1] - 1
        size = end - begin
        place = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        text = np.repeat(has, size)
        pairs = [(text[ok := v[place]], b[place[ok]]) for b, v in self.grams(0, self.n)]
        return np.concatenate([t for t, _ in pairs]), np.concatenate([b for _, b in pairs])


def chunks(texts: list) -> Iterator[slice]:
    begin = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size > CHUNK:
            yield slice(begin, k + 1)
            begin, size = k + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def train(texts: list[str | None], labels: list[int], epochs: int = 10, whole: int = 2, rate: float = 0.3, seed: int = 7) -> dict:
    """Learn from labelled texts: {"weight": one number a bucket, "bias"}. The same rows give the same model."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    linear = rng.normal(0, 0.5, (2, DIM)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen_e, seen_l, seen_b = np.full((BUCKETS, DIM), 1e-6, np.float32), np.full((2, DIM), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    y_all = np.array(labels)
    if not len(y_all):
        return {"weight": np.zeros(BUCKETS, np.float32), "bias": -3.0}
    toxic = max(float((y_all == 1).mean()), 1e-3)
    weigh = np.where(y_all == 1, min(4.0, 0.5 / toxic), 1.0).astype(np.float32)
    order = rng.permutation(len(texts))
    parts = [order[s] for s in chunks([texts[k] for k in order])]
    for epoch in range(epochs):
        for part in (parts[k] for k in rng.permutation(len(parts))):
            f = Features([texts[k] for k in part])
            if epoch < whole:
                low, high = f.first[:-1], f.first[1:]
            else:
                _, low, high = f.worst(embed @ (linear[1] - linear[0]))
            text, bucket = f.bag(low, high)
            for group in np.array_split(np.arange(len(part)), max(1, len(part) // 64)):
                a, b = np.searchsorted(text, group[0]), np.searchsorted(text, group[-1], "right")
                pick = (text >= group[0]) & (text <= group[-1])
                t, k = text[pick] - group[0], bucket[pick]
                m, n = len(group), np.maximum(np.bincount(t, minlength=len(group)), 1).astype(np.float32)
                mean = np.stack([np.bincount(t, embed[k, d], m) for d in range(DIM)], 1).astype(np.float32) / n[:, None]
                z = mean @ linear.T + bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                y = y_all[part[group]]
                p[np.arange(m), y] -= 1
                p *= (weigh[part[group]] / m)[:, None]
                grad_linear, grad_bias, back = p.T @ mean, p.sum(axis=0), (p @ linear) / n[:, None]
                rows, which = np.unique(k, return_inverse=True)
                grad = np.stack([np.bincount(which, back[t, d], len(rows)) for d in range(DIM)], 1).astype(np.float32)
                seen_e[rows] += grad**2
                embed[rows] -= rate * grad / np.sqrt(seen_e[rows])
                seen_l += grad_linear**2
                linear -= 0.3 * rate * grad_linear / np.sqrt(seen_l)
                seen_b += grad_bias**2
                bias -= 0.3 * rate * grad_bias / np.sqrt(seen_b)
    return {"weight": (embed @ (linear[1] - linear[0])).astype(np.float32), "bias": float(bias[1] - bias[0])}


def score(model: dict, texts: list[str | None]) -> np.ndarray:
    """Probability of label 1 for each text; that of the bias alone for texts without words."""
    out = np.empty(len(texts))
    for s in chunks(texts):
        best = Features(texts[s]).best(model["weight"])
        z = np.where(np.isfinite(best), best, 0) + model["bias"]
        out[s] = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    return out


def held_out(doc_id) -> F.Column:
    """Rows that must not be learnt from: CRC-32 of the id as text leaves 1 modulo 3. Null ids: false."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> dict:
    """Train on at most max_train labelled documents (doc_id, toxic), chosen by hash, none held out.

    Labels repeated for a doc_id count once, the highest; null labels and ids do not count. Of several texts under
    one doc_id that of least hash is learnt from. Without labels every text scores the same.
    """
    named = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out("doc_id")).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    chosen = named.orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MAX_TRAIN_BYTES).join(F.broadcast(chosen), "_id")
    rows = rows.groupBy("_id", "_toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))  # one row a label, however often its id is repeated

    @trimmed
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["_id"])
        model = train([r["text"] for r in found], [int(r["_toxic"] > 0) for r in found])
        yield pa.RecordBatch.from_pydict({"weight": [model["weight"].tobytes()], "bias": [model["bias"]]})

    # one task of at most max_train texts; the driver sees the model alone
    made = rows.select("_id", "_toxic", "text").coalesce(1).mapInArrow(learn, "weight binary, bias double").first()
    return {"weight": np.frombuffer(made["weight"], np.float32), "bias": made["bias"]} if made else train([], [])


def apply(docs: DataFrame, model: dict, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry and score of every row, whole texts; null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number a bucket, 1 MB
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    scored = "text" if "text" in carry else "_text"

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                value = score(shared.value, part.column(scored).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(value, pa.float64())], [*carry, "score"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry)
    rows = docs.select(*carry) if scored == "text" else docs.select(*carry, F.col("text").alias("_text"))
    return rows.mapInArrow(run, f"{schema}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text); predicted 1 from a score of 0.7 on.

    Whole texts are scored, of any length. Null, empty and wordless texts score alike. Rows that repeat a text
    have its score each; a null doc_id stays null and is not held out. Other columns are ignored; an empty table
    gives an empty result.
    """
    scored = apply(docs, fit(docs, labels, max_train))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
