"""The operators' queries on the given tables against their SQL, brute force or held-out labels."""

import collections
import hashlib
import os
import re
from html.parser import HTMLParser

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.llm import catalog, quality, toxicity
from tests.llm.test_operators import brute_groups, windows_hit

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")


def given(table, folder=SMALL):
    return duckdb.sql(f"SELECT * FROM '{folder}/{table}.parquet'").fetchall()


@pytest.fixture(scope="module")
def documents():
    return {i: t for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, name):
    base = duckdb.connect()
    for path in os.listdir(SMALL):
        base.execute(f"CREATE VIEW {path.partition('.')[0]} AS SELECT * FROM '{SMALL}/{path}'")
    said = base.execute(catalog.ORACLES[name])
    names = [c[0] for c in said.description]
    found = catalog.QUERIES[name](spark, SMALL)
    assert sorted(found.columns) == sorted(names)
    flat = lambda rows: sorted((tuple(round(r[k], 6) if isinstance(r[k], float) else r[k] for k in sorted(r)) for r in rows), key=str)
    assert flat(r.asDict() for r in found.collect()) == flat(dict(zip(names, r, strict=True)) for r in said.fetchall())


class Article(HTMLParser):
    """Blocks of the one article of a page, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1", "h2", "li", "article"):
            self.blocks.append("")
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "h2", "li", "article"):
            self.blocks.append("")
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_op1(spark):
    found = {r["page_id"]: r for r in catalog.op1_html(spark, LARGER).collect()}
    pages = given("pages", LARGER)
    assert len(found) == len(pages)
    for page_id, url, html in pages:
        reader = Article()
        reader.feed(html)
        want = "\n\n".join(x for x in (" ".join(b.split()) for b in reader.blocks) if x)
        assert (found[page_id]["url"], found[page_id]["text"], found[page_id]["n_chars"]) == (url, want, len(want))


def test_op2_on_rows_held_out(spark):
    """Labels of a third of the ids are never seen; few clean ones of them are flagged, and at least half of the toxic are."""
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").where("toxic IS NOT NULL")
    found = catalog.op2_toxicity(spark, LARGER)
    rows = found.join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    count = collections.defaultdict(int, {(r["toxic"], r["predicted"]): r["count"] for r in rows})
    assert count[1, 1] >= count[1, 0] and 50 * count[0, 1] <= count[0, 0]
    assert found.where(F.col("held_out") != toxicity.held_out("doc_id")).count() == 0
    assert found.where((F.col("score") >= 0.7) != (F.col("predicted") == 1)).count() == 0


def test_op4_on_rows_held_out(spark):
    """Trees that saw the labels of even ids alone sort the documents of odd ones."""
    docs, labels = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet").where("quality IS NOT NULL")
    found = quality.quality(docs, labels.where("doc_id % 2 = 0")).where("doc_id % 2 = 1 AND NOT base_failed").join(labels, "doc_id")
    rows = [(r["quality"] == 1, r["kept"]) for r in found.collect()]
    assert len(rows) > 100 and sum(a == b for a, b in rows) >= 0.97 * len(rows)


def test_op4_counts(spark, documents):
    for r in catalog.op4_quality(spark, SMALL).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", documents[r["doc_id"]] or "")
        windows = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        repeated = {j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(repeated))
        assert r["base_failed"] == (len(words) < 10 or 100 * len(repeated) > 20 * len(words)) and not (r["base_failed"] and r["kept"])


def test_op7(spark, documents):
    items = {i: t for i, t in given("benchmark") if t}
    grams = lambda t: {tuple(w[k : k + min(5, len(w))]) for w in [(t or "").lower().split()] for k in range(max(0, len(w) - min(5, len(w)) + 1))}
    sets = {i: grams(t) for i, t in items.items()}
    for r in catalog.op7_decontaminate(spark, SMALL).collect():
        text = documents[r["doc_id"]]
        own = grams(text)
        want = [i for i, t in items.items() if (len(t.split()) < 5 or own & sets[i]) and windows_hit(text, t)]
        assert sorted(r["item_ids"]) == sorted(want) and r["contaminated"] == bool(want), r["doc_id"]


def test_op8(spark, documents):
    want = brute_groups([(i, t, 0) for i, t in documents.items()])
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in catalog.op8_near_dup(spark, SMALL).collect()}
    assert found == want and len({c for _, c in want.values()}) < len(want)


def test_op9(spark, documents):
    seen = collections.Counter()
    data = {i: (t or "").encode() for i, t in documents.items()}
    for b in data.values():
        seen.update(hashlib.md5(b[k : k + 200]).digest() for k in range(len(b) - 199))
    for r in catalog.op9_substrings(spark, SMALL).collect():
        b = data[r["doc_id"]]
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[hashlib.md5(b[k : k + 200]).digest()] > 1:
                gone[k : k + 200] = b"\x01" * 200
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()), r["doc_id"]
