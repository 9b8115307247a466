import collections
import hashlib
import os
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import catalog, chat, common, decontaminate, html, lines, mixing, near_dup, quality, substrings, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, id long, tie long, score double"


@pytest.fixture(params=[common.BROADCAST_CELLS, 0], ids=["broadcast", "shuffle"])
def joins(request, monkeypatch):
    """Both sides of the bound up to which a table is broadcast."""
    monkeypatch.setattr(common, "BROADCAST_CELLS", request.param)


def table(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, None, 1, 2, 3, 0.5) for i, t, s in rows], DOCS)


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(n))


A, B, C = prose(1, 120), prose(2, 120), prose(3, 60)
EDGE = [(1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (None, "null id", "b"), (4, "x", None), (4, "x", None)]


def test_html():
    page = '<body><nav><a href="/">Home</a></nav><article><h1>T</h1><p>One &amp; two,  three.<br>Four.<p>Last</article><div class="comments"><p>Nice, really.</div><footer>f</footer>'
    assert html.extract(page) == "T\n\nOne & two, three. Four.\n\nLast"
    assert [html.extract(x) for x in (None, "", "<p>", "plain &lt; text", "<script>x")] == ["", "", "", "plain < text", ""]


def test_html_keeps_what_lies_around_the_body():
    long = [f"Paragraph {k} tells a long story, with commas, and it goes on; then, after a while, it ends. " * 4 for k in range(12)]
    body = "".join(f"<p>{x}</p>" for x in long)
    want = "\n\n".join(["T", "A lead, in short.", *map(str.strip, long)])
    for outer in ("article", "main", "div"):
        page = f'<body><div><a href="/">Home</a></div><{outer}><h1>T</h1><p>A lead, in short.</p><div class="body">{body}</div><div class="share">Share, now.</div></{outer}>'
        assert html.extract(page) == want, outer
    assert html.extract(f"<main><h1>T</h1><p>A lead, in short.</p><article>{body}</article></main>") == want
    assert html.extract(f"<article><section>{body}</section><section><h2>Later</h2><p>Short.</p></section></article>").endswith("Later\n\nShort.")


STORY = [f"Paragraph {k} tells a long story, with commas, and it goes on; then, after a while, it ends. " * 4 for k in range(6)]


def test_html_without_telling_markup(monkeypatch):
    """Bare divs: the ratios alone tell text from menus, link lists and short notices."""
    body = "".join(f"<p>{x}</p>" for x in STORY)
    want = "\n\n".join(["A title", *map(str.strip, STORY), "One", "Two"])
    menu = "".join(f'<div><a href="/{k}">Entry {k}</a></div>' for k in range(9))
    page = f"<body><div><div>{menu}</div><div>We use things. Agree?</div><div><h1>A title</h1>{body}<ul><li>One<li>Two</ul></div><div>Read this too: <a href=x>more</a></div><div>Made by us</div></div></body>"
    assert html.extract(page) == want
    page = f"<body>{menu}<table><tr><td>{menu}</td><td><h1>A title</h1>{body}{menu}<ul><li>One</li><li>Two</li></ul></td><td>Weather: rain</td></tr></table>"
    assert html.extract(page) == want
    monkeypatch.setattr(html, "path_ratios", lambda p: np.ones(len(p.texts)))
    assert html.extract(page) != want


def test_html_names_and_broken_markup():
    assert html.extract('<article><div class="related-work">Kept, as it is no aside.</div><div class="related-links">Gone, as it is.</div><p class="x>Hello world</p></article>') == "Kept, as it is no aside.\n\nHello world"
    for name in ("reader-comments", "userComments", "ad-1", "cookie-banner", "related-articles", "site-notice main"):
        assert html.extract(f'<article><p>Text, here.</p><section id="x" class="{name}"><p>Other text, there.</p></section></article>') == "Text, here.", name
    for name in ("comments-open", "related-work", "shared-values", "story", "header-image-caption"):
        assert html.extract(f'<article><p>Text, here.</p><section class="{name}"><p>Other text, there.</p></section></article>').endswith("there."), name
    assert html.extract("<article><header><h1>T</h1><div>By me</div></header><p>Text, here.</p><div hidden>x</div></article><div>Other text, there.</div>") == "T\n\nText, here."
    assert html.extract('<p>a<p title="b>c">d<!-- e --><![CDATA[f<g]]>h<') == "a\n\ndf<gh<"
    pages = ["<div>" * 90_000 + "x", '<a "' * 250_000, "<svg>" * 200_000, "<article>" + "<div><header>" * 70_000, "<dl><dd><div>" + "<center>" * 60_000 + "<dt></dt>" * 60_000 + "x"]
    for page in pages:
        begin = time.process_time()
        html.extract(page)
        assert time.process_time() - begin < 5, page[:20]


def test_path_ratios_match_brute_force():
    page = html.Page("<div><p>One, two. Three<p><a href=x>link</a> some<ul><li>a<li>b.</ul><div class=k><p>One, two. Three</div><h2>Head</h2><p>Long, " + "text. " * 40 + "</div>")
    names = ["div/p", "div/p", "div/ul/li", "div/ul/li", "div/div.k/p", "div/h2", "div/p"]
    assert page.texts[:6] == ["One, two. Three", "link some", "a", "b.", "One, two. Three", "Head"] and len(page.texts) == 7
    text, mark, free = collections.defaultdict(list), collections.defaultdict(list), {}
    for n, t, k in zip(names, page.texts, page.linked):
        text[n].append(len(t) - k)
        mark[n].append(0 if k else sum(c in ".,;:!?" for c in t))
    for n in set(names):
        free[n] = sum(text[n]) / sum(len(t) for m, t in zip(names, page.texts) if m == n)
    ratios = [(np.mean(text[n]), np.mean(mark[n])) for n in names]
    ratios[5] = tuple(np.maximum(ratios[5], ratios[6]))

    def smooth(v, k):
        near = [(np.exp(-((j - k) ** 2) / 2), v[j]) for j in range(len(v)) if abs(j - k) <= 2]
        return sum(w * x for w, x in near) / sum(w for w, _ in near)

    logs = np.log1p(np.array(ratios))
    want = [(1 + smooth(logs[:, 0], k)) * (1 + smooth(logs[:, 1], k)) * free[n] for k, n in enumerate(names)]
    assert html.path_ratios(page) == pytest.approx(np.array(want))


def test_html_on_spark(spark):
    pages = spark.createDataFrame([(1, None, None, 5), (1, "u", "<p>é</p>", 6), (None, "u", "<p>é</p>", 6)], "page_id long, url string, html string, text int")
    assert sorted((r["text"], r["n_chars"]) for r in html.main_text(pages).collect()) == [("", 0), ("é", 1), ("é", 1)]
    assert html.main_text(pages.limit(0)).count() == 0


def test_toxicity_learns_unseen_misspellings():
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for k in range(400):
        words = prose(k + 10, int(rng.integers(5, 300))).split()
        if k % 4 == 0:
            words[rng.integers(len(words))] = rng.choice(["grumblefool", "grumblefoolish", "xgrumblefool", "grumblefoool"])
        texts.append(" ".join(words))
        labels.append(int(k % 4 == 0))
    model = toxicity.train(texts[:300], labels[:300])
    score = toxicity.score(model, texts[300:])
    assert ((score >= toxicity.THRESHOLD) == np.array(labels[300:])).mean() > 0.95
    seen = toxicity.score(model, ["the grumblefoolz are " + texts[1], texts[1], "", None])
    assert seen[0] > 0.7 > seen[1] and seen[2] == seen[3]


def test_toxicity_edges(spark):
    docs, labels = table(spark, EDGE), spark.createDataFrame([(1, None), (3, 1), (None, 1), (3, 0)], "doc_id long, toxic int")
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == len(EDGE) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in found)
    assert toxicity.toxicity(docs.limit(0), labels.limit(0)).count() == 0


def test_chat(spark):
    turns = {1: "ab", 2: "abc", 3: "abc", 4: "abd", 5: "b", 6: "a", 7: "aa"}
    rows = [(c, k, "user", x, 0) for c, t in turns.items() for k, x in enumerate(t)] + [(None, 0, "user", "a", 0), (8, None, None, None, 0)]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n int")
    found = chat.render(data).orderBy("conv_id", "place").collect()
    assert sorted({r["conv_id"] for r in found}) == [2, 4, 5, 7, 8]
    whole = collections.defaultdict(str)
    for r in found:
        assert r["start"] == len(whole[r["conv_id"]])
        whole[r["conv_id"]] += r["rendered"]
    assert whole[5] == "<|im_start|>user\nb<|im_end|>\n" and whole[8] == "<|im_start|>unknown\n<|im_end|>\n"
    assert chat.render(data.limit(0)).count() == 0


def test_long_chat_in_blocks(spark):
    rows = spark.range(10_000).select((F.col("id") % 2).alias("conv_id"), F.floor(F.col("id") / 2).alias("turn"), F.lit("user").alias("role"), F.floor(F.col("id") / 2).cast("string").alias("text"))
    rows = rows.where("conv_id = 1 OR turn < 4500")
    assert {r["conv_id"] for r in chat.maximal(rows).select("conv_id").distinct().collect()} == {1}


def test_quality_counts_match_brute_force():
    for text in (None, "", "a b c d e f a b c d e g", "x\nx\n \nx", A + " " + A[:200], "é*# ü|\x0b<b> z", " ".join(prose(9, 7000).split() * 2)):
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
        windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        full = [x for x in (text or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(full) - len(set(full)), len(covered))
        assert quality.statistics(text)[0] == want


def test_quality_trees_are_monotonic():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = (x[:, 0] + 0.3 * rng.random(2000) > 0.6).astype(float)
    model = quality.grow(x, y, [1, -1, 0])
    assert ((quality.predict(model, x) > 0.5) == y).mean() > 0.85
    grid = np.tile(x[:50], (20, 1))
    for j, sign in ((0, 1), (1, -1)):
        g = grid.copy()
        g[:, j] = np.repeat(np.linspace(0, 1, 20), 50)
        p = quality.predict(model, g).reshape(20, 50)
        assert (sign * np.diff(p, axis=0) >= -1e-12).all()


def test_long_texts_score_as_whole(monkeypatch):
    """Scores do not depend on the blocks that a text is read in, nor on the texts beside it."""
    texts = [" ".join(prose(k, 4).split() * 900) for k in range(3)] + ["w" * 50_000, None, "", "a b " + prose(5, 900)]
    weight = np.random.default_rng(3).normal(0, 1, toxicity.BUCKETS).astype(np.float32)
    whole = toxicity.score({"weight": weight, "bias": -1.0}, texts)
    assert toxicity.Features(texts).best(weight) == pytest.approx(toxicity.Features(texts).worst(weight)[0])
    monkeypatch.setattr(toxicity, "CHUNK", 1000)
    assert toxicity.score({"weight": weight, "bias": -1.0}, texts) == pytest.approx(whole)


def test_labels_of_repeated_ids(spark):
    """Rows that repeat a labelled id are one row of the sample, so it stays as bounded as the labels."""
    rows = [(1, A, "a")] * 50 + [(2, B, "a"), (2, C, "a"), (3, "z" * (toxicity.MAX_TRAIN_BYTES + 1), "a")]
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in (1, 2, 3)] * 2, "doc_id long, toxic int, quality int")
    seen = {}
    for module, name in ((toxicity, "train"), (quality, "grow")):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(module, name, lambda *a, module=module: seen.setdefault(module, len(a[0])) and {})
            module.fit(table(spark, rows), labels)
    assert seen[quality] == 3 and seen[toxicity] == len([k for k in (1, 2) if __import__("zlib").crc32(str(k).encode()) % 3 != 1])


def test_quality_edges(spark):
    found = quality.quality(table(spark, [*EDGE, (9, A, "b")]), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r["doc_id"] for r in found if not r["base_failed"]} == {9} and len(found) == 7
    assert quality.quality(table(spark, []), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_lines(spark, joins):
    one, two, hot = "one two three four five", "six seven eight nine ten", "short line"
    rows = [(1, f"{one}\n{hot}\n{two}", "a"), (2, f"{hot}\n ONE  two three\tfour five\nnew words are here now\n{one}", "a"), (3, f"{two}\n{two}", "a"), *EDGE]
    found = {(r["doc_id"], r["kept"]): r["spans"] for r in lines.remove_lines(table(spark, rows), min_words=5).collect()}
    assert found[2, f"{hot}\nnew words are here now"] == [(11, 36), (60, 83)]
    assert found[1, rows[0][1]] == [] and len(found[3, ""]) == 2 and (None, "null id") in found and (1, "") in found
    paragraphs = lines.remove_lines(table(spark, [(1, f"{one}\n\n{two}", "a"), (2, f"x\n\n{one}", "a")]), "paragraph").collect()
    assert {r["kept"] for r in paragraphs} == {f"{one}\n\n{two}", "x"} and lines.remove_lines(table(spark, []), "line").count() == 0


def test_short_lines(spark, tmp_path):
    whole = "从前有一个人住在山上。"
    rows = [(1, "A  1\nb\n\nx"), (2, "a 2\n\n \nB\ny"), (3, f"{whole}\nb"), (4, f"z\n{whole}\nX")]
    table(spark, [(i, t, "a") for i, t in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: (r["n_spans"], r["n_removed"], r["spans"], r["text"]) for r in catalog.op5_lines(spark, str(tmp_path)).collect()}
    assert found == {1: (0, 0, "", rows[0][1]), 2: (2, 4, "0-3 7-8", "\n \ny"), 3: (1, 1, "12-13", whole), 4: (2, 12, "2-13 14-15", "z")}


def test_lines_agree_with_sql(spark, tmp_path):
    """The query and its SQL on passages that several documents have as lines."""
    passages = [prose(300 + k, 60) for k in range(4)]
    rows = [(k, "\n".join([prose(k, 12), passages[k % 4], "All rights reserved.", prose(k + 50, 12)])) for k in range(12)] + [(20, None), (21, ""), (22, "\n\n")]
    table(spark, [(i, t, "a") for i, t in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    found = agree(spark, "op5_lines", tmp_path)
    assert all((passages[k % 4] in found[k]["text"]) == (k < 4) for k in range(12))
    assert all("rights" not in found[k]["text"] and prose(k, 12) in found[k]["text"] for k in range(1, 12))


def agree(spark, name, folder, key="doc_id"):
    """The query's rows by key, equal to those of its SQL over the same folder."""
    found = getattr(catalog, name)(spark, str(folder))
    base = duckdb.connect()
    for path in sorted(os.listdir(folder)):
        base.execute(f"CREATE VIEW {path.partition('.')[0]} AS SELECT * FROM '{folder}/{path}/*.parquet'")
    said = base.execute(catalog.ORACLES[name])
    names = [c[0] for c in said.description]
    order = lambda r: tuple((v is not None, v) for _, v in sorted(r.items()))
    rows = sorted((r.asDict() for r in found.collect()), key=order)
    assert rows == sorted((dict(zip(names, r, strict=True)) for r in said.fetchall()), key=order)
    return {r[key]: r for r in rows}


def test_warc(spark, joins):
    body = "<p>é</p>" * 30
    rows = [(5, "u", body, 1), (2, None, body, 1), (9, "u\r\n%", body, 1), (7, "u", "short", 1), (8, "u", "short", 1), (3, "u", None, 1), (4, "u", "", 1), (None, "u", body, 1), (2, "v", body, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    bundles = warc.write(pages).cache()
    found = warc.read(bundles).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["record_type"] == "revisit":
            assert r["page_id"] in (5, 9, 2, None) and r["refers_to"] == 2 and r["payload_bytes"] == len(body.encode()) and r["payload"] is None
        else:
            assert hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] and r["refers_to"] is None
    assert [(r["page_id"], r["url"]) for r in found if r["record_type"] == "response" and r["payload_bytes"] >= 100] == [(2, "v")]
    assert sorted(r["url"] for r in found if r["page_id"] == 9) == ["u\r\n%"]
    bundle = bundles.first()
    entry = bundle["entries"][-1]
    frame = warc.read_frame(bundle["content"], warc.seek_table(bundle["content"]), entry["frame"])
    assert warc.parse(frame[entry["start"] :][: entry["length"]])["page_id"] == entry["page_id"]
    assert warc.read(warc.write(pages.limit(0))).count() == 0
    wanted = spark.createDataFrame([(9,), (9,), (77,), (None,)], "page_id long")
    [where] = warc.lookup(bundles, wanted).collect()
    content = {r["bundle"]: r["content"] for r in bundles.collect()}[where["bundle"]]
    frame = warc.read_frame(content, warc.seek_table(content), where["frame"])
    assert warc.parse(frame[where["start"] :][: where["length"]])["url"] == "u\r\n%"


def test_warc_agrees_with_sql(spark, tmp_path):
    long, other = "<p>é</p>" * 20, "<b>x</b>" * 40
    rows = [(3, "u", long), (3, "u", long), (3, None, long), (4, "u", long), (None, "u", long), (None, "u", other), (None, "v", other), (5, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload int")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    agree(spark, "op6_warc", tmp_path, "page_id")


def test_warc_files(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"<p>{k}</p>") for k in range(20)], "page_id long, url string, html string").repartition(3)
    bundles = warc.write(pages).cache()
    for folder in (f"{tmp_path}/a", f"file://{tmp_path}/b"):
        names = {r["bundle"] for r in warc.export(bundles, folder).collect()} | {r["bundle"] for r in warc.export(bundles, folder).collect()}
        home = tmp_path / folder[-1]
        assert names == set(os.listdir(home))
        assert {(home / r["bundle"]).read_bytes() == r["content"] for r in bundles.collect()} == {True}


def test_warc_many_frames(monkeypatch):
    frames = [(warc.zstandard.compress(bytes([k]) * 100), 100) for k in range(20)]
    content = warc.frames_and_table(frames)
    assert warc.read_frame(content, warc.seek_table(content), 7) == bytes([7]) * 100
    reader = warc.zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True)
    assert reader.read() == b"".join(bytes([k]) * 100 for k in range(20))


def windows_hit(text, item):
    def grams(words):
        k = min(5, len(item.split()))
        return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]

    want, have = collections.Counter(grams(item.lower().split())), grams((text or "").lower().split())
    size = min(sum(want.values()), len(have))
    for i in range(len(have) - size + 1):
        common = sum((collections.Counter(have[i : i + size]) & want).values())
        if size and 100 * common >= 75 * (size + sum(want.values()) - common):
            return True
    return False


def test_decontaminate(spark, joins):
    w = C.split()
    items = [(1, C), (2, " ".join(w[:20]) + " other"), (3, "tiny Item"), (4, None), (5, ""), (6, "a b c d e a b c d e a b c d e f")]
    near = " ".join([*w[:30], "changed", *w[31:]])
    far = " ".join(x if k % 7 else "changed" for k, x in enumerate(w))
    docs = [(1, f"{A} {C.upper()} {B}", "a"), (2, f"{A} {near}", "a"), (3, far, "a"), (4, A, "a"), (5, "the tiny item here", "a"), (6, " ".join(w[:18]), "a"), (7, "x a b c d e a b c d e a b c d e f y", "a"), (8, "a b c d e f", "a"), *[(i and i + 20, t, s) for i, t, s in EDGE]]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, size int")
    found = {r["doc_id"]: [m["item_id"] for m in r["matches"]] for r in decontaminate.decontaminate(table(spark, docs), bench).collect()}
    for i, text, _ in docs:
        assert found[i] == [k for k, item in items if item and windows_hit(text, item)], i
    assert found[1] and found[2] and not found[4]
    assert decontaminate.decontaminate(table(spark, docs), bench.limit(0)).where("contaminated").count() == 0


def test_decontaminate_edited_passages(spark):
    """Passages with words changed, put in and left out, about as many as the threshold allows, against all windows of all items."""
    rng = np.random.default_rng(12)
    items = [prose(700 + k, int(n)) for k, n in enumerate(rng.integers(8, 60, 8))] + ["a b a b a b a b a b c"]
    docs = []
    for i in range(90):
        words = items[i % len(items)].split()
        for _ in range(rng.integers(0, 1 + max(1, len(words) // 20))):
            at, kind = rng.integers(len(words)), rng.integers(3)
            words[at : at + (kind != 1)] = [] if kind == 2 else ["new%d" % rng.integers(99)]
        docs.append((i, " ".join([prose(i, int(rng.integers(0, 25))), *words, prose(i + 300, int(rng.integers(0, 25)))]).strip(), "a"))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {r["doc_id"]: [m["item_id"] for m in r["matches"]] for r in decontaminate.decontaminate(table(spark, docs), bench).collect()}
    want = {i: [k for k, item in enumerate(items) if windows_hit(text, item)] for i, text, _ in docs}
    assert found == want and 20 < sum(map(bool, want.values())) < 85


def brute_groups(rows):
    sets = {}
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        sets.setdefault(i, set()).update(tuple(w[j : j + k]) for j in range(len(w) - k + 1) if k)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(spark, joins):
    rng = np.random.default_rng(5)
    rows, i = [(1, None, "a"), (2, "", "a"), (3, " \n", "a"), (4, "Few words", "a"), (5, "few  words", "a"), (6, "few words more", "a")], 10
    for base in range(12):
        words = prose(100 + base, 80).split()
        for _ in range(25):
            copy = list(words)
            for _ in range(rng.integers(0, 5)):
                copy[rng.integers(len(copy))] = "edit%d" % rng.integers(1000)
            if rng.random() < 0.3:
                words = copy
            rows.append((i, " ".join(copy), "a"))
            i += 1
    want = brute_groups(rows)
    found = near_dup.near_duplicates(table(spark, [*rows, (None, A, "a"), rows[-1]])).collect()
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    again = near_dup.near_duplicates(table(spark, [(1, A, "a"), (1, B, "a"), (2, A + " x", "a"), (3, B + " y", "a"), (4, C, "a")])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in again} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    left = near_dup.one_of_each(table(spark, [*rows, rows[0], rows[6]])).collect()
    assert sorted(r["doc_id"] for r in left if r["doc_id"] > 3) == sorted(i for i, (_, c) in want.items() if i == c and i > 3)
    assert near_dup.near_duplicates(table(spark, [])).count() == 0


def test_forest_orders():
    rng = np.random.default_rng(8)
    sigs = rng.integers(0, 3, (400, near_dup.VALUES)).astype(np.uint16)
    key, deep = near_dup.tree_labels(sigs)
    for t in (0, 5, near_dup.TREES - 1):
        turned = np.roll(sigs, -near_dup.LEAST_DEPTH * t, axis=1)[:, : near_dup.LEAST_DEPTH + near_dup.MORE]
        for a, b in rng.integers(0, 400, (300, 2)):
            apart = np.flatnonzero(turned[a] != turned[b])
            depth = int(apart[0]) if len(apart) else turned.shape[1]
            assert (key[a, t] == key[b, t]) == (depth >= near_dup.LEAST_DEPTH)
            if depth >= near_dup.LEAST_DEPTH:
                assert near_dup.common_prefix(deep[a, t : t + 1], deep[b, t : t + 1])[0] == depth


def test_neighbours_meet_over_batches():
    rng = np.random.default_rng(9)
    key = np.sort(rng.integers(0, 60, 200))
    deep, node, root = rng.integers(-(1 << 63), (1 << 63) - 1, 200), rng.permutation(200), rng.integers(0, 3, 200)
    whole = near_dup.pa.RecordBatch.from_pydict({"key": key, "deep": deep, "node": node, "root": root})
    parts = [whole.slice(k, 7) for k in range(0, 200, 7)]
    rows = lambda kernel, given: sorted(str(r) for b in kernel(iter(given)) for r in b.to_pylist())
    assert rows(near_dup._neighbours, parts) == rows(near_dup._neighbours, [whole])
    assert rows(near_dup._across, parts) == rows(near_dup._across, [whole])
    found = [r for b in near_dup._neighbours(iter(parts)) for r in b.to_pylist()]
    many = collections.Counter(key.tolist())
    assert {r["node"] for r in found} == {n for n, k in zip(node, key) if many[k] > 1} | {node[0], node[-1]}
    met = {(r["node"], r["other"]) for b in near_dup._across(iter(parts)) for r in b.to_pylist()}
    for i in range(200):
        before = [j for j in range(i) if key[j] == key[i] and root[j] != root[i]]
        assert not before or (node[i], node[before[-1]]) in met


def test_one_of_each_without_ids(spark, joins):
    near = B.split()
    near[60] = "edited"
    rows = [(1, A, "a"), (None, A, "a"), (None, B, "a"), (None, B, "b"), (None, " ".join(near), "a"), (None, C, "a"), (None, None, "a"), (None, " ", "a"), (None, " ", "a")]
    left = near_dup.one_of_each(table(spark, rows))
    assert left.schema == table(spark, []).schema
    found = collections.Counter((r["doc_id"], r["text"]) for r in left.collect())
    assert found[1, A] == found[None, C] == found[None, None] == found[None, B] + found[None, " ".join(near)] == 1
    assert found[None, " "] == 2 and not found[None, A] and found.total() == 6


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 90), (90, 95), (7, 7)]
    found = dict(map(tuple, common.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert found == {k: 0 for k in range(31)} | {90: 90, 95: 90, 100: 90}


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("hot", [1, 100_000])
def test_substrings(spark, joins, keep_first, hot):
    shared = prose(7, 60)[:230]
    rows = [(1, A + shared + B, "a"), (2, B[:100] + shared + "é" + C, "a"), (3, shared[10:215], "a"), (4, "z" * 450, "a"), (5, "ab" * 150 + A[:120], "a"), (6, None, "a"), (7, "", "a"), (8, prose(8, 30) * 2, "a"), (9, B, "a"), (10, shared[:199], "a")]
    seen = collections.defaultdict(list)
    for i, t, _ in rows:
        b = (t or "").encode()
        for k in range(len(b) - 199):
            seen[b[k : k + 200]].append((i, k))
    for r in substrings.remove_repeats(table(spark, rows), keep_first, hot=hot).collect():
        b = (dict((i, t) for i, t, _ in rows)[r["doc_id"]] or "").encode()
        spans = [{"start": k, "end": k + 200} for k in range(len(b) - 199) if len(seen[b[k : k + 200]]) > 1 and not (keep_first and seen[b[k : k + 200]][0] == (r["doc_id"], k))]
        assert [(s["start"], s["end"]) for s in r["spans"]] == substrings.merge(spans), r["doc_id"]
        assert r["n_bytes"] == len(b) and len(r["kept"]) == len(b) - sum(y - x for x, y in substrings.merge(spans))


def test_substrings_repeated_rows_and_empty(spark, joins):
    found = substrings.remove_repeats(table(spark, [(1, A, "a"), (1, A, "a"), (None, "short", "b")]), False).collect()
    assert sorted(len(r["kept"]) for r in found) == [0, 0, 5]
    assert substrings.remove_repeats(table(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_longest_previous_factors(seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(97, 99 + seed % 3, 150).astype(np.uint8)
    if seed > 3:
        data = np.tile(data[: 10 * seed], 4)
    text, most = data.tobytes(), 12
    start = np.arange(len(text) - most + 1)
    rank = substrings.suffix_ranks(data, most)[start]
    order = np.lexsort((start, rank))
    found, earlier = substrings.longest_previous(order, substrings.common_prefixes(data, start[order], most), start)

    def common(i, j):
        return next((k for k in range(most) if text[i + k] != text[j + k]), most)

    assert found.tolist() == [max((common(i, j) for j in range(i)), default=0) for i in start]
    assert all((j < 0) == (n == 0) and (n == 0 or j < i and common(i, j) == n) for i, (n, j) in enumerate(zip(found, earlier, strict=True)))


@pytest.mark.parametrize("piece", [1, 7, 250, 1000])
def test_runs_do_not_depend_on_pieces(monkeypatch, piece):
    data = (prose(5, 200) + "z" * 500 + prose(6, 100)).encode()

    def strings():
        anchor, _, first, count, offset = substrings.runs(data)
        return sorted((f + k, a, f + o) for a, f, c, o in zip(anchor.tolist(), first.tolist(), count.tolist(), offset.tolist(), strict=True) for k in range(c))

    whole = strings()
    assert [x[0] for x in whole] == list(range(len(data) - 199)) and len(substrings.runs(b"x" * 199)[0]) == 0
    monkeypatch.setattr(substrings, "PIECE", piece)
    assert strings() == whole


def test_suffix_ranks():
    data = np.frombuffer(b"abracadabra" * 30 + b"zabracadabra", np.uint8)
    rank, text = substrings.suffix_ranks(data, 20), data.tobytes()
    order = sorted(range(len(text)), key=lambda k: text[k : k + 20].ljust(20, b"\x00"))
    assert [text[k : k + 20] for k in order] == [text[k : k + 20] for k in sorted(range(len(text)), key=lambda k: rank[k])]
    inner = range(len(text) - 19)
    assert all((rank[i] == rank[j]) == (text[i : i + 20] == text[j : j + 20]) for i in inner for j in inner)


def test_mixing(spark):
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 40))), s) for s, n in (("a", 3), ("b", 200), ("c", 50), (None, 40)) for k in range(len(s or "") * 1000 + ord((s or "z")[0]) * 1000, len(s or "") * 1000 + ord((s or "z")[0]) * 1000 + n)]
    rows += [(1, None, "b"), (None, "x y", "b"), (None, "x y", "b"), (5, "", "empty")]
    found = mixing.mix(table(spark, rows)).collect()
    assert len(found) == len(rows)
    by = collections.defaultdict(list)
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]].append(r)
    total = sum(r["size"] for r in found)
    assert abs(sum(v[0]["target"] for v in by.values()) - 1.5 * total) < 1e-6
    for v in by.values():
        assert v[0]["target"] <= 2 * v[0]["source_size"] + 1e-9 and abs(sum(r["taken"] for r in v) - v[0]["target"]) <= 1
    again = mixing.mix(table(spark, rows[::-1])).collect()
    assert sorted(map(str, again)) == sorted(map(str, found)) and mixing.mix(table(spark, [])).count() == 0


def brute_targets(sizes, weights=(5, 2, 1)):
    """Deal the budget by weight again and again, each time without the sources that it fills."""
    weight, target, open_ = {k: weights[i % 3] for i, k in enumerate(sorted(sizes))}, {}, set(sizes)
    while open_:
        level = (1.5 * sum(sizes.values()) - sum(target.values())) / sum(weight[k] for k in open_)
        full = {k for k in open_ if level * weight[k] > 2.0 * sizes[k]}
        target |= {k: 2.0 * sizes[k] if full else level * weight[k] for k in full or open_}
        open_ -= full or open_
    return target


def test_mixing_targets(spark):
    rng = np.random.default_rng(4)
    cases = [[100] * n for n in (1, 3, 4)] + [[0, 0], [0, 100, 7]] + [rng.integers(0, 100_000, n).tolist() for n in (2, 5, 20, 60)]
    for sizes in cases:
        sizes = {f"s{k:02}": x for k, x in enumerate(sizes)}
        found = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert found == pytest.approx(brute_targets(sizes)) and min(found.values()) >= 0
        assert sum(found.values()) == pytest.approx(1.5 * sum(sizes.values()))
    rows = [(k, "w " * 100, s) for k, s in enumerate("abcd")]
    assert {r["source"]: r["taken"] for r in mixing.mix(table(spark, rows)).collect()} == {"a": 200, "b": 133, "c": 66, "d": 200}


def test_toxicity_learns_on_an_executor(spark, monkeypatch):
    """The driver gets the model, not the texts, and the model is that of the sorted rows."""
    docs = spark.createDataFrame([(k, f"word{k % 7} other text {'awful' if k % 3 == 0 else 'kind'}") for k in range(60)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 3 = 0 AS INT) AS toxic")
    free = [r for r in docs.withColumn("h", toxicity.held_out("doc_id")).orderBy("doc_id").collect() if not r["h"]]
    known = toxicity.train([r["text"] for r in free], [int(r["doc_id"] % 3 == 0) for r in free])

    def never(*_):
        raise AssertionError("texts on the driver")

    monkeypatch.setattr(type(docs), "toLocalIterator", never)
    found = toxicity.fit(docs.repartition(5), labels)
    assert np.array_equal(found["weight"], known["weight"]) and found["bias"] == known["bias"]
