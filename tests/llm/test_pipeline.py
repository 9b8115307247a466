import pytest

import corpus_pipeline
from tests.llm.test_operators import brute_groups, prose, windows_hit

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, rows, labels, items):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_edges(spark, tmp_path):
    """Nulls in any column, empty and blank texts, repeated rows, one word of many letters, and names that operators use."""
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (3, " \n\t", "en", "a", 3), (None, "null id", "en", "b", 7), (4, "x", "en", None, 1), (4, "x", "en", None, 1), (5, "w" * 30_000, "en", "a", 30_000), (6, prose(1, 3000), "en", "a", None)]
    tables(spark, tmp_path, rows, [(1, None), (None, 1), (2, 0), (99, 1)], [(1, None), (None, "x"), (2, "")])
    wide = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "1 AS id", "2 AS tie", "'s' AS size", "0.5D AS score", "'k' AS kept", "array(1) AS spans", "true AS contaminated", "1 AS component_id")
    left = {"toxicity": 8, "near_dedup": 7, "substring_dedup": 8, "decontamination": 8, "mixing": 8}
    for name, function in corpus_pipeline.STAGES:
        found = function(spark, wide, str(tmp_path))
        assert found.count() == left[name], name
        assert name == "mixing" or found.columns == list(corpus_pipeline.COLUMNS)
    total = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r["size"] for r in total) == 3000 + 1 + 1 + 2 and all(0 <= r["taken"] <= 2 * r["size"] for r in total)


@pytest.mark.parametrize("labels", [[], [(1, 1)]])
def test_empty(spark, tmp_path, labels):
    tables(spark, tmp_path, [], labels, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages(spark, tmp_path):
    base = {k: prose(500 + k, 60) for k in range(120)}
    passage = prose(900, 70)
    rows = [(k, t + (" vile grumblefool" if k % 5 == 0 else "")) for k, t in base.items()]
    rows += [(200, base[1]), (201, base[2].replace(base[2].split()[30], "edited", 1)), (202, base[3] + " " + passage), (203, passage + " " + base[4] + " " + prose(901, 90))]
    rows += [(204, prose(902, 40) + " " + prose(903, 30))]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int("grumblefool" in t)) for i, t in rows[:110]], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(903, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "mixing"]
    seen, at = {}, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        at = spark.read.parquet(f"{tmp_path}/out{k}")
        seen[name] = {r["doc_id"]: r for r in at.collect()}
        if k < 4:
            assert at.columns == list(corpus_pipeline.COLUMNS)
    clean = {i for i, t in rows if "grumblefool" not in t}
    assert clean - set(seen["toxicity"]) == set() and len(set(seen["toxicity"]) - clean) <= 2
    groups = brute_groups([(i, r["text"], 0) for i, r in seen["toxicity"].items()])
    assert set(seen["near_dedup"]) == {i for i, (_, c) in groups.items() if i == c}
    assert passage[:200] in seen["substring_dedup"][202]["text"] and passage not in seen["substring_dedup"][203]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in seen["substring_dedup"].values())
    assert set(seen["substring_dedup"]) - set(seen["decontamination"]) == {i for i, r in seen["substring_dedup"].items() if windows_hit(r["text"], prose(903, 30))} == {204}
    assert set(seen["mixing"]) == set(seen["decontamination"])
    total = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["taken"] for r in total} == {i: r["taken"] for i, r in seen["mixing"].items()}
