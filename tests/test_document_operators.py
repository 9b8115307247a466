from pyspark.sql import functions as F

from quire.functions.fold import fold, fold_text
from quire.operators import revisions as R
from quire.operators import text as T


def test_fold(spark):
    samples = "Étudié ΩÆß Å 한하 がá XYZ"
    assert spark.range(1).select(fold(F.lit(samples))).first()[0] == fold_text(samples)
    assert fold_text("ÅÉ") == "ae" and fold_text("Ω") == "Ω"


def test_overlapping_matches(spark):
    pages = spark.createDataFrame([(1, "aaaa"), (2, "b.A+a.a"), (3, ""), (4, "x")], "id int, text string")
    found = lambda q: sorted(map(tuple, T.match_starts(pages, q, ["id"]).collect()))
    assert found("aa") == [(1, 0), (1, 1), (1, 2)]
    assert found("a.") == [(2, 4)] and found("a+a") == [(2, 2)] and found("") == []


def test_lines_break_by_height(spark):
    rows = [(1, k, c, float(k), y, 10.0) for k, (c, y) in enumerate([("A", 100.0), ("2", 104.0), ("B", 100.0), ("C", 80.0)])]
    glyphs = spark.createDataFrame(rows, "id int, seq int, uni string, x double, y double, d double")
    assert T.page_text(glyphs, ["id"]).first()["text"] == "A2B\nC"
    found = T.chars(glyphs, ["id"]).orderBy("pos").collect()
    assert [r["ch"] for r in found] == ["A", "2", "B", "\n", "C"] and found[3]["x0"] is None
    assert T.hit(T.chars(glyphs, ["id"]), ["id"], F.lit(500.0), F.lit(80.0)).first()["pos"] == 4


def test_words_and_lines_at(spark):
    pages = spark.createDataFrame([(1, "un mot_é, x\nfin")], "id int, text string")
    at = lambda f, k: tuple(f(pages, ["id"], F.lit(k)).first())[1:3]
    assert at(T.word_at, 4) == (3, 8) and at(T.word_at, 8) == (8, 9) and at(T.word_at, 99) == (99, 99)
    assert at(T.line_at, 13) == (12, 15) and at(T.line_at, 99) == (12, 15)


def test_undo_redo(spark):
    log = spark.createDataFrame([(1, k, a) for k, a in enumerate(["undo", "commit", "commit", "undo", "redo", "undo", "commit", "redo"])], "doc int, seq long, action string")
    assert {r["seq"]: r["alive"] for r in R.replay(log, "doc").collect()} == {1: True, 2: False, 6: True}


def test_runs(spark):
    rows = spark.createDataFrame([(n,) for n in [*range(3, 40), 41, *range(64, 96), 100]], "n long")
    assert sorted(map(tuple, R.runs_of_numbers(rows, "n", 8).collect())) == [(3, 37), (41, 1), (64, 32), (100, 1)]


def test_boxes_in_glyphs(spark):
    """In any order of rows, as page_text(), chars() and their matches have it; pages dealt out beforehand shuffle no glyph."""
    rows = [(p, k, c, float(k), 100.0 - 30 * (k // 5), 10.0) for p in (1, 2) for k, c in enumerate(["t", "i", "ON", None, "T", "", "ti", "o", "n", "tió"])]
    glyphs = spark.createDataFrame(rows[::-1], "id int, seq long, uni string, x double, y double, d double").repartition(3)
    for query in ("tion", "ti", "o", "\n"):
        known = T.match_boxes(T.chars(glyphs, ["id"]), T.match_starts(T.page_text(glyphs, ["id"]), query, ["id"]), len(query), ["id"])
        assert sorted(map(tuple, T.boxes_in_glyphs(glyphs, query, ["id"]).collect())) == sorted(map(tuple, known.collect()))
    pages = T.dealt(spark.createDataFrame([(1, "nation\nTion"), (2, "")], "doc_id int, text string"), ["doc_id"])
    found = T.boxes_in_glyphs(T.synthetic_glyphs(pages), "tion", ["doc_id"], together=True)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(r["pos"] for r in found.collect()) == [2, 7]
