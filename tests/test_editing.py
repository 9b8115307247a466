import json

import numpy as np
import pytest

from quire.__main__ import main
from quire.operators import editing
from quire.operators import text as T
from quire.sources.pdf import images
from quire.sources.pdf.cos import Name, PdfError, Ref, Stream
from quire.sources.pdf.document import Document
from quire.sources.pdf.tables import flat_glyphs, pdf_table, rows
from quire.sources.pdf.write import Session, standalone
from quire.sources.sinks import text_files, write_files
from tests.pdfs import simple, text_page

JPEG = b"\xff\xd8\xff\xc0\x00\x11\x08\x00\x14\x00\x1e\x03" + bytes(9) + b"\xff\xd9"


def one(data, name, **options):
    return list(rows(name, "d", data, **options))


def test_marks_are_restyled_and_moved():
    session = Session(simple([text_page("A"), text_page("B")]))
    session.highlight(0, [10, 10, 30, 20], [1, 1, 0])
    session.highlight(0, [10, 50, 30, 60], [1, 0, 0], "Underline")
    session.move(0, 1)
    session.restyle(1, 0, [0, 1, 0], 2.0)
    session.move_annotation(1, 1, [50, 120, 10, 100])
    found = one(session.save(), "annotations")
    assert [(r["page"], r["subtype"]) for r in found] == [(1, "Highlight"), (1, "Underline")]
    assert found[0]["color"] == [0, 1, 0] and found[1]["rect"] == [10, 100, 50, 120]
    doc = Document(session.save())
    quads = doc.get(doc.get(doc.get(doc.pages()[1].dict["Annots"])[1])["QuadPoints"])
    assert quads == [10, 120, 50, 120, 10, 100, 50, 100]
    assert doc.get(doc.get(doc.get(doc.pages()[1].dict["Annots"])[0])["ca"]) == 1
    session.free_text(0, [0, 0, 50, 20], "x")
    for wrong in ((0, 0), (0, 5), (9, 0)):
        with pytest.raises(PdfError):
            session.restyle(*wrong)


def test_image_page_and_undo():
    session = Session(simple([text_page("A")]))
    session.insert_image(0, JPEG)
    assert one(session.save(), "pages")[0]["media_box"] == [0, 0, 30, 20]
    image = one(session.save(), "images")
    assert [(r["width"], r["height"], r["error"]["code"]) for r in image] == [(30, 20, "BadImage")]  # a frame header and no samples
    assert session.undo() and len(one(session.save(), "pages")) == 1
    session.insert_blank(5)
    assert len(one(session.save(), "pages")) == 2
    with pytest.raises(PdfError):
        session.insert_image(0, b"no image")


def test_filled_field_shows_its_value():
    session = Session(simple([text_page("a")], AcroForm={"Fields": [Ref(50, 0)]}))
    session.commit({50: {"FT": Name("Tx"), "T": b"name", "Rect": [0, 0, 90, 20], "V": b"old", "Subtype": Name("Widget")}, 10: session.current(Ref(10, 0)) | {"Annots": [Ref(50, 0)]}})
    session = Session(session.save())
    session.set_field("name", b"new")
    assert "".join(r["uni"] for r in one(session.save(), "glyphs", include_annotations=True)) == "anew"


def test_images_keep_their_samples():
    mask = Stream({"Width": 2, "Height": 1, "BitsPerComponent": 8, "ColorSpace": Name("DeviceGray")}, bytes([0, 200]))
    grey = {"Subtype": Name("Image"), "Width": 4, "Height": 2, "BitsPerComponent": 8, "ColorSpace": Name("DeviceGray"), "SMask": Ref(4, 0)}
    cmyk = {"Subtype": Name("Image"), "Width": 1, "Height": 1, "BitsPerComponent": 8, "ColorSpace": Name("DeviceCMYK")}
    data = standalone({1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 2: {"Type": Name("Pages"), "Kids": [Ref(3, 0)], "Count": 1}, 3: {"Type": Name("Page"), "Contents": Ref(5, 0), "Resources": {"XObject": {"A": Ref(6, 0), "B": Ref(7, 0), "C": Ref(8, 0)}}}, 4: mask, 5: Stream({}, b"/A Do /B Do /C Do xx"), 6: Stream(grey, bytes(range(8))), 7: Stream(cmyk, bytes([255, 0, 0, 0])), 8: Stream(cmyk, b"")}, 1)
    a, b, c = one(data, "images")
    pixels = np.frombuffer(a["rgba"], np.uint8).reshape(2, 4, 4)
    assert pixels[1, :, 0].tolist() == [4, 5, 6, 7] and pixels[0, :, 3].tolist() == [0, 0, 200, 200]
    assert list(b["rgba"]) == [0, 255, 255, 255] and c["error"]["code"] == "BadImage"
    assert images.png(pixels).startswith(b"\x89PNG") and images.difference(pixels, pixels) == (0, 0)
    assert images.difference(pixels, np.where(pixels == 7, 17, pixels).astype(np.uint8)) == (10, 1)
    found = one(data, "summary")[0]
    assert (found["images"], found["glyphs"], found["ignored"]) == (3, 0, {"xx": 1})
    assert [(r["op"], r["operands"]) for r in one(data, "instructions")][:2] == [("Do", "[/A]"), ("Do", "[/B]")]


def test_edit_log_on_spark(spark):
    files = spark.createDataFrame([("a.pdf", simple([text_page("A"), text_page("B")])), ("b.pdf", b"junk"), ("c.pdf", None), ("d.pdf", simple([text_page("D")]))], "path string, content binary")
    log = [("a.pdf", 2, "rotate", {"at": 0, "delta": -90}), ("a.pdf", 1, "move", {"origin": 0, "target": 1}), ("a.pdf", 3, "free_text", {"at": 0, "rect": [0, 0, 90, 20], "text": "note"}), ("b.pdf", 1, "delete", {"at": 0}), ("d.pdf", 1, "delete", {"at": 7}), ("e.pdf", 1, "undo", {})]
    log = spark.createDataFrame([(p, s, a, json.dumps(x)) for p, s, a, x in log], "path string, seq int, action string, arguments string")
    found = {r["path"]: r for r in editing.edit_files(files, log).collect()}
    assert sorted(found) == ["a.pdf", "b.pdf", "c.pdf", "d.pdf"]
    assert found["a.pdf"]["error"] is None and found["d.pdf"]["error"]["code"] == "PageOutOfRange" and found["b.pdf"]["error"]
    pages = one(bytes(found["a.pdf"]["content"]), "pages")
    assert [p["rotate"] for p in pages] == [270, 0] and bytes(found["c.pdf"]["content"]) == b""
    empty = editing.edit_files(files.limit(0), log)
    assert empty.count() == 0


def test_files_from_pages_of_files(spark):
    files = spark.createDataFrame([("a.pdf", simple([text_page("A"), text_page("B")])), ("b.pdf", simple([text_page("C")]))], "path string, content binary")
    plan = spark.createDataFrame([("m", 1, "a.pdf", 1), ("m", 2, "b.pdf", None), ("m", 3, "a.pdf", 0), ("x", 1, "none.pdf", 0), ("y", 1, "b.pdf", 4)], "target string, seq int, path string, page int")
    found = {r["path"]: r for r in editing.assemble_files(files, plan).collect()}
    made = spark.createDataFrame([("m.pdf", bytes(found["m"]["content"]))], "path string, content binary")
    assert [r["uni"] for r in pdf_table(made, "glyphs").orderBy("page").collect()] == ["B", "C", "A"]
    assert found["x"]["error"]["code"] == "MissingFile" and found["y"]["error"]["code"] == "PageOutOfRange"
    assert all(len(r["content"]) for r in editing.optimise_files(files).collect())


def test_one_file_a_row(spark, tmp_path):
    pages = spark.createDataFrame([("x/a.pdf", 1, "zwei"), ("x/a.pdf", 0, "eins"), ("y/a.pdf", 0, None)], "doc string, page int, text string")
    write_files(text_files(pages), str(tmp_path / "out"))
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"a.txt": "eins\f\nzwei", "a-2.txt": ""}
    with pytest.raises(Exception, match="not a file name"):
        write_files(spark.createDataFrame([("../a", b"")], "name string, content binary"), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").iterdir())) == 2


def test_commands(tmp_path, capsys):
    source, out = tmp_path / "a.pdf", tmp_path / "b.pdf"
    source.write_bytes(simple([text_page("Hello", "there"), text_page("B")]))
    assert main(["text", str(source)]) == 0 and capsys.readouterr().out == "Hello\nthere\n"
    assert main(["move-page", str(source), str(out), "0", "1"]) == 0 and main(["text", str(out)]) == 0
    assert capsys.readouterr().out == "B\n"
    assert main(["add-text", str(source), str(out), "0", "1", "2", "90", "20", "hi"]) == 0
    assert main(["render-info", str(out)]) == 0 and json.loads(capsys.readouterr().out)["glyphs"] == 12
    assert main(["merge", str(out), str(source), str(source)]) == 0 and main(["split", str(out), str(source), "3", "0"]) == 0
    assert main(["optimize", str(source), str(out)]) == 0 and main(["bench", str(out)]) == 0
    assert json.loads(capsys.readouterr().out)["pages"] == 2
    for command in ("dump", "verify-signatures"):
        assert main([command, str(out)]) == 0
    assert main(["delete-page", str(source), str(out), "9"]) == 1 and main(["text", str(tmp_path / "none.pdf")]) == 1


def test_runs_and_glyphs_agree(spark):
    turned = b"BT /F1 12 Tf 2 Tc 3 Tw 90 Tz 0 1 -1 0 100 100 Tm (up ward) Tj 1 0.3 0 1 0 500 Tm (slanted line) Tj [(a b) -500 (c)] TJ /None 9 Tf (??) Tj ET 0 0 9 9 re f BT /F1 5 Tf 3 3 Td (end) Tj ET"
    data = simple([turned, text_page("A", "B"), b"", b"(unclosed"])
    files = spark.createDataFrame([("d", data), ("bad", b"x")], "path string, content binary")
    plain = spark.createDataFrame(one(data, "glyphs"), pdf_table(files, "glyphs").schema)
    key = lambda r: (r["page"], r["seq"] or 0)
    fast = pdf_table(files, "glyphs")
    assert sorted(fast.where("doc = 'd'").collect(), key=key) == sorted(plain.collect(), key=key)
    assert fast.where("doc = 'bad'").first()["error"]["code"] and fast.where("page = 3").first()["error"]
    told = {r["page"]: r["text"] for r in pdf_table(files, "page_text").where("doc = 'd'").collect()}
    lines = {r["page"]: r["text"] for r in T.page_text(flat_glyphs(fast), ["doc", "page"]).collect()}
    assert {k: v for k, v in told.items() if v} == lines and told[2] == "" and told[3] is None
