"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics.

Trees are grown in numpy on histograms of a bounded labelled sample, with monotonic constraints on chosen
features, and flattened into node arrays that score whole batches level by level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import trimmed

SPACES = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS, MOST_REPEAT_PERCENT = 10, 20
#: Most labelled documents used for training, those of least hash.
MAX_TRAIN = 9000
KEEP_FROM = 0.5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Inputs of the trees and the sign of their effect on the score: -1 can only lower it, 1 only raise it, 0 free.
FEATURES = {"log_words": 0, "mean_word": 0, "symbol_ratio": -1, "dup_line_ratio": -1, "repeat_ratio": -1, "digit_ratio": 0, "upper_ratio": 0, "mark_ratio": 0, "ended_lines": 0, "mean_line": 0, "distinct_ratio": 1, "wide_ratio": 0, "longest_word": 0, "short_line_ratio": 0}


def n_repeat_words(words: list[bytes]) -> int:
    """Words inside WINDOW-word windows that occur at least twice in the text, the first included."""
    n = len(words)
    if n <= WINDOW:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    key, size = w[: n - WINDOW + 1], len(ids)
    for k in range(1, WINDOW):
        if size * len(ids) >= 1 << 62:
            kinds, key = np.unique(key, return_inverse=True)
            size = len(kinds)
        key = key * len(ids) + w[k : n - WINDOW + 1 + k]
        size *= len(ids)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def statistics(text: str | None) -> tuple[tuple[int, ...], list[float]]:
    """The five base counts and the features of one whole text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    solid = data.translate(None, SPACES)
    wide = len(data) - len(text)  # bytes of characters beyond ASCII, less one each
    chars = len(text) - (len(data) - len(solid))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeats = n_repeat_words(words)
    base = len(words), chars, symbols, len(lines) - len(set(lines)), repeats
    n, c, m = max(len(words), 1), max(chars, 1), max(len(lines), 1)
    digits = len(data) - len(data.translate(None, b"0123456789"))
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = len(data) - len(data.translate(None, b".,;:!?"))
    ended = sum(x.rstrip()[-1:] in b".!?" for x in lines)
    short = sum(len(x) < 30 for x in lines)
    features = [np.log1p(len(words)), chars / n, symbols / c, base[3] / m, repeats / n, digits / c, upper / c, marks / c, ended / m, len(words) / m, len(set(words)) / n, wide / c, max(map(len, words), default=0), short / m]
    return base, features


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: int = 5) -> dict[str, np.ndarray]:
    """Boosted trees for labels y by logistic loss, flattened: feature (-1 in leaves), cut, left, right, value, root."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(x.shape[1])], 1) if len(x) else np.zeros(x.shape, int)
    nodes: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "right", "value")}
    roots = []
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    bias = np.log(share / (1 - share))
    margin = np.full(len(y), bias)

    def node() -> int:
        for key, empty in (("feature", -1), ("cut", 0.0), ("left", -1), ("right", -1), ("value", 0.0)):
            nodes[key].append(empty)
        return len(nodes["value"]) - 1

    def build(at: int, rows: np.ndarray, level: int, low: float, high: float) -> None:
        g, h = grad[rows], hess[rows]
        total_g, total_h = g.sum(), h.sum()
        best = (1e-6, -1, 0, 0.0, 0.0)
        if level < depth and len(rows) >= 2 * least:
            for j, cut in enumerate(cuts):
                if not len(cut):
                    continue
                code = codes[rows, j]
                size = len(cut) + 1
                gl, hl, nl = (np.cumsum(np.bincount(code, w, size))[:-1] for w in (g, h, None))
                gr, hr = total_g - gl, total_h - hl
                vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                gain = -(gl * vl + (hl + ridge) * vl**2 / 2) - (gr * vr + (hr + ridge) * vr**2 / 2) - total_g**2 / (total_h + ridge) / 2
                bad = (nl < least) | (len(rows) - nl < least) | ((vr - vl) * signs[j] < 0)
                gain[bad] = -np.inf
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
        _, j, k, vl, vr = best
        if j < 0:
            nodes["value"][at] = rate * float(np.clip(-total_g / (total_h + ridge), low, high))
            margin[rows] += nodes["value"][at]
            return
        middle = (vl + vr) / 2  # children of a constrained split stay on their side of the middle
        left, right = node(), node()
        nodes["feature"][at], nodes["cut"][at], nodes["left"][at], nodes["right"][at] = j, float(cuts[j][k]), left, right
        under = codes[rows, j] <= k
        build(left, rows[under], level + 1, max(low, middle) if signs[j] < 0 else low, min(high, middle) if signs[j] > 0 else high)
        build(right, rows[~under], level + 1, max(low, middle) if signs[j] > 0 else low, min(high, middle) if signs[j] < 0 else high)

    for _ in range(trees if len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        roots.append(node())
        build(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)
    kinds = {"feature": np.int32, "left": np.int32, "right": np.int32}
    return {k: np.array(v, kinds.get(k, np.float64)) for k, v in nodes.items()} | {"root": np.array(roots, np.int32), "bias": np.array(bias), "depth": np.array(depth)}


def predict(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Probability of label 1: all rows go down all trees together, one level at a time."""
    at = np.tile(model["root"], (len(x), 1))
    for _ in range(int(model["depth"])):
        feature = model["feature"][at]
        inner = feature >= 0
        under = np.take_along_axis(x, np.maximum(feature, 0), 1) <= model["cut"][at] if at.size else np.zeros(at.shape, bool)
        at = np.where(inner, np.where(under, model["left"][at], model["right"][at]), at)
    return 1 / (1 + np.exp(-(model["bias"] + model["value"][at].sum(axis=1))))


def _measure(carry: tuple[str, ...], model: dict[str, np.ndarray] | None):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, features = [], []
            for text in batch.column("_text"):
                b, f = statistics(text.as_py())
                base.append(b)
                features.append(f)
            columns = [*(batch.column(c) for c in carry), *(pa.array(list(c), pa.int64()) for c in (zip(*base, strict=True) if base else [()] * len(BASE)))]
            x = np.array(features).reshape(len(features), len(FEATURES))
            last = pa.array(list(x), pa.list_(pa.float64())) if model is None else pa.array(predict(model, x), pa.float64())
            yield pa.RecordBatch.from_arrays([*columns, last], [*carry, *BASE, "features" if model is None else "quality_score"])

    return run


def measure(docs: DataFrame, model: dict[str, np.ndarray] | None = None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry, the base counts and the trees' score (without a model: the features) of every row; null texts are empty."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), *(f"{c} long" for c in BASE), "features array<double>" if model is None else "quality_score double"])
    return docs.select(*carry, F.col("text").alias("_text")).mapInArrow(_measure(carry, model), schema)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> dict[str, np.ndarray]:
    """Trees from at most max_train labelled documents (doc_id, quality), chosen by hash.

    Repeated labels count once, the lowest; of several texts under one doc_id that of least hash counts.
    """
    named = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("_quality"))
    chosen = named.orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(chosen), "_id")
    rows = rows.groupBy("_id", "_quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    found = sorted(measure(rows, None, ("_id", "_quality")).select("_id", "_quality", "features").collect())
    x = np.array([r["features"] for r in found]).reshape(len(found), len(FEATURES))
    return grow(x, np.array([int(r["_quality"] > 0) for r in found], float), list(FEATURES.values()))


def quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, base counts, base_failed, quality_score and kept of every document.

    base_failed: fewer than 10 words, or more than 20 % of them in repeated windows. kept is false then, else
    the trees' verdict. Null and empty texts have no words and fail. Without labels the score is 0.5 for all.
    Rows that repeat a text have its result each, null doc_ids stay null, other columns are ignored, and an
    empty table gives an empty result.
    """
    rows = measure(docs, fit(docs, labels, max_train))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality_score") >= KEEP_FROM))
