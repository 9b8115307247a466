from quire.plans.catalog import QUERIES
from quire.streaming.ingest import arriving, ingest
from quire.streaming.requests import mark_stale
from tests.pdfs import simple, text_page


def test_stream_marks_stale_requests_across_batches(spark, tmp_path):
    batches = [[(1, 1, 1, 5.0), (2, 1, 2, 3.0), (3, 2, 1, None)], [(4, 1, 3, 4.0), (5, 1, 4, 6.0), (6, 2, 2, 0.0), (7, 1, 5, None)]]
    schema = "id int, user int, ts int, gen double"
    query = None
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = mark_stale(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "user", ["ts"], "gen", ["id"])
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    found = {r["id"]: r["stale"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {1: False, 2: True, 3: False, 4: True, 5: False, 6: False, 7: False}


def test_stream_and_table_agree(spark):
    folder = "/root/testdata/sf0.001"
    a, b = (sorted(map(tuple, QUERIES[q](spark, folder).select("event_id", "user_id", "stale").collect())) for q in ("stale_requests", "stale_requests_stream"))
    assert a == b and len(a) > 100


def test_arriving_files_are_parsed_once(spark, tmp_path):
    inbox, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    inbox.mkdir()
    for name, text in (("a.pdf", "one"), ("b.pdf", "two")):
        (inbox / name).write_bytes(simple([text_page(text)]))
        ingest(arriving(spark, str(inbox)), out, state).awaitTermination()
    (inbox / "c.pdf").write_bytes(b"junk")
    ingest(arriving(spark, str(inbox)), out, state).awaitTermination()
    pages = spark.read.parquet(f"{out}/page_text")
    assert sorted(r["text"] for r in pages.where("error IS NULL").collect()) == ["one", "two"] and pages.where("error IS NOT NULL").count() == 1
    found = spark.read.parquet(f"{out}/files").collect()
    assert len(found) == 3 and sum(r["error"] is not None for r in found) == 1
