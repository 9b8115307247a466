import base64
import hashlib
import os
import zlib

import pyarrow as pa
import pytest

from quire.operators import text as T
from quire.sources.pdf import crypt, filters
from quire.sources.pdf.cos import Name, Parser, PdfError, Ref, Stream, instructions, serialise, text_string
from quire.sources.pdf.document import Document
from quire.sources.pdf.fonts import to_unicode
from quire.sources.pdf.interpret import Interpreter
from quire.sources.pdf.tables import flat_glyphs, pdf_table, rows
from quire.sources.pdf.write import Session, assemble
from tests.pdfs import simple, text_page


def words(data):
    doc = Document(data)
    return ["".join(x["uni"] or "" for x in Interpreter(doc).page(p, True) if x["kind"] == "glyph") for p in doc.pages()]


def test_objects_round_trip():
    value = {"A": [1, -2.5, True, None, b"(x)\x00", Name("a b#"), Ref(3, 0)], "B": {"C": 0.000001}}
    assert Parser(serialise(value)).object() == value
    assert Parser(rb"(a\(b\)\101\n(c))").object() == b"a(b)A\n(c)"
    assert Parser(b"<48 656>").object() == b"He`"
    assert Parser(b"99999999999999999999").object() == 1e20
    assert [x for x in (Parser(b"/A#42").object(), text_string(b"\xfe\xff\x00e\x00t"), text_string(b"\xff"))] == ["AB", "et", "�"]
    with pytest.raises(PdfError):
        Parser(b"[1 foo]").object()
    assert instructions(b"1 0 0 rg BI /W 1 ID \x00\x01EI\nEI (a) Tj") == [("rg", [1, 0, 0]), ("BI", []), ("Tj", [b"a"])]


def test_filters():
    data = bytes(range(256)) * 5
    assert filters.flate(zlib.compress(data)) == data
    with pytest.raises(PdfError):
        filters.flate(zlib.compress(data)[:-6])
    assert filters.ascii_hex(b"48 65 6>") == b"He`"
    assert filters.ascii85(b"<~87cURD]i,\"Ebo80~>") == b"Hello World!"
    assert filters.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert filters.unpredict(bytes([2, 1, 2, 3, 2, 1, 1, 1]), {"Predictor": 12, "Columns": 3}) == bytes([1, 2, 3, 2, 3, 4])
    assert filters.unpredict(bytes([4, 1, 2, 3, 3, 2, 2, 2]), {"Predictor": 15, "Columns": 3})[:3] == bytes([1, 3, 6])
    assert filters.unpredict(bytes([1, 1, 1]), {"Predictor": 2, "Columns": 3}) == bytes([1, 2, 3])


def test_pages_text_and_rebuild():
    data = simple([text_page("Page one", "second line"), text_page("Two")])
    assert words(data) == ["Page onesecond line", "Two"]
    broken = data[: data.rfind(b"xref\n", 0, data.rfind(b"startxref"))]
    doc = Document(broken + b"trailer <</Root 1 0 R>>")
    assert doc.rebuilt and len(doc.pages()) == 2


def test_edits_undo_and_append():
    session = Session(simple([text_page("A"), text_page("B"), text_page("C")]))
    session.move(0, 2)
    session.insert_blank(1)
    session.rotate(0, -90)
    session.highlight(0, [72, 700, 100, 712], [1, 1, 0])
    session.free_text(2, [100, 100, 300, 120], "note")
    out = session.save()
    assert out.startswith(session.doc.data)
    assert words(out) == ["B", "", "Cnote", "A"] and Document(out).pages()[0].rotate == 270
    while session.undo():
        pass
    assert words(session.save()) == ["A", "B", "C"]
    assert session.redo() and words(session.save()) == ["B", "C", "A"]
    session.delete(0)
    assert words(session.save()) == ["C", "A"] and not session.redo()
    with pytest.raises(PdfError):
        session.delete(7)


def test_merge_and_split():
    a, b = Document(simple([text_page("A"), text_page("B")])), Document(simple([text_page("C")]))
    assert words(assemble([(a, 0), (b, 0), (a, 1)])) == ["A", "C", "B"]
    split = Document(assemble([(a, 1)]))
    assert len(split.pages()) == 1 and len(split.xref) < len(a.xref)


def test_ciphers():
    key, iv, block = bytes(range(16)), bytes(16), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert crypt.aes_cbc(key, iv, block, True).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    long = crypt.aes_cbc(bytes(range(32)), iv, block * 3, True)
    assert long[:16].hex() == "8ea2b7ca516745bfeafc49904b496089" and crypt.aes_cbc(bytes(range(32)), iv, long) == block * 3
    assert crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


def test_encrypted_file():
    password, file_id = b"secret", b"0123456789abcdef"
    base = {"Filter": Name("Standard"), "V": 2, "R": 3, "Length": 128, "O": bytes(32), "P": -4}
    key = hashlib.md5((password + crypt.PAD)[:32] + bytes(32) + (0xFFFFFFFC).to_bytes(4, "little") + file_id).digest()
    for _ in range(50):
        key = hashlib.md5(key).digest()
    check = hashlib.md5(crypt.PAD + file_id).digest()
    for k in range(20):
        check = crypt.rc4(bytes(c ^ k for c in key), check)
    plain = simple([text_page("hidden")])
    own = hashlib.md5(key + (11).to_bytes(3, "little") + bytes(2)).digest()
    body = text_page("hidden")
    data = plain.replace(body, crypt.rc4(own, body)).replace(b"/Root 1 0 R", b"/Root 1 0 R /ID [" + serialise(file_id) + b"] /Encrypt " + serialise(base | {"U": check + bytes(16)}))
    doc = Document(data, password)
    assert doc.content(doc.pages()[0]) == body
    with pytest.raises(PdfError, match="IncorrectPassword"):
        Document(data, b"wrong")
    assert next(rows("files", "x", data))["error"]["code"] == "IncorrectPassword"


def test_ligatures_keep_their_letters():
    assert to_unicode(b"1 beginbfchar <01> <006600660069> endbfchar 1 beginbfrange <02> <03> <0041> endbfrange") == {1: "ffi", 2: "A", 3: "B"}


def test_tables_on_spark(spark):
    good = simple([text_page("Étude".encode("ascii", "ignore").decode() + " one", "line two"), text_page("x")])
    files = spark.createDataFrame([("good", good), ("bad", b"not a file"), ("empty", b"")], "path string, content binary")
    found = {r["doc"]: r for r in pdf_table(files, "files").collect()}
    assert found["good"]["n_pages"] == 2 and found["bad"]["error"]["code"] and found["empty"]["error"]["code"]
    glyphs = flat_glyphs(pdf_table(files, "glyphs"))
    pages = {(r["doc"], r["page"]): r["text"] for r in T.page_text(glyphs, ["doc", "page"]).collect()}
    assert pages == {("good", 0): "tude one\nline two", ("good", 1): "x"}
    for name in ("xref", "objects", "edges", "pages", "items", "outline", "annotations", "fields", "signatures"):
        assert all(r["error"] is None or r["doc"] != "good" for r in pdf_table(files, name).collect()), name


def test_forms_and_outline():
    fields = [Ref(50, 0), Ref(51, 0)]
    data = simple([text_page("a"), text_page("b")], AcroForm={"Fields": fields}, Outlines={"First": Ref(60, 0)})
    session = Session(data)
    session.commit({50: {"FT": Name("Tx"), "T": b"name", "Rect": [0, 0, 9, 9], "V": b"old"}, 51: {"FT": Name("Btn"), "T": b"ok", "Rect": [0, 0, 9, 9], "AS": Name("Off"), "AP": {"N": {"Off": None, "Yes": None}}}, 60: {"Title": b"First", "Dest": [Ref(12, 0), Name("Fit")], "Next": Ref(61, 0), "First": Ref(62, 0)}, 61: {"Title": b"Last", "Next": Ref(60, 0)}, 62: {"Title": b"Inner", "Dest": [Ref(10, 0)]}})
    session = Session(session.save())
    session.set_field("name", b"new")
    session.set_field("ok", Name("Yes"))
    found = {r["name"]: (r["kind"], r["value"]) for r in rows("fields", "d", session.save())}
    assert found == {"name": ("text", "new"), "ok": ("checkbox", "true")}
    assert {(r["title"], r["depth"], r["page"]) for r in rows("outline", "d", session.save())} == {("First", 0, 1), ("Last", 0, None), ("Inner", 1, 0)}
    assert Stream() == Stream()


def test_tokens_with_and_without_escapes():
    """The plain form of a token and its rarer forms mean the same."""
    assert Parser(b"<< /A#42 1 /C [ 1 0 R -0.5 +5 .5 4. ] % note\n /D <</E (x)>> /F<4a4B> >>").object() == {"AB": 1, "C": [Ref(1, 0), -0.5, 5, 0.5, 4.0], "D": {"E": b"x"}, "F": b"JK"}
    assert instructions(b"1 0 R") == [("R", [1, 0])]
    with pytest.raises(PdfError):
        Parser(b"<< /A >>").object()
    with pytest.raises(PdfError):
        Parser(b"[" * 300).object()


def test_rows_of_small_files_share_batches(spark, monkeypatch):
    """References stand beside the objects, and a batch holds the rows of many files."""
    from quire.plans import made_files
    from quire.sources.pdf import tables

    data = made_files.classic(made_files.paged([made_files.stream(made_files.simple_text("x"))] * 3))
    refs = [(r["num"], x["key_path"], x["dst"]) for r in rows("objects", "x", data) for x in r["refs"]]
    assert refs and refs == [(r["src"], r["key_path"], r["dst"]) for r in rows("edges", "x", data)]
    files = spark.createDataFrame([(str(k), data) for k in range(50)], "path string, content binary").coalesce(1)
    sizes = tables._read(files.selectExpr("path", "content", "CAST(NULL AS STRING) AS password"), "objects", {}).select("num")
    assert sizes.count() == 50 * len(list(rows("objects", "x", data)))
    sent = []
    monkeypatch.setattr(type(files), "mapInArrow", lambda self, run, schema: sent.append(run) or self)
    tables._read(files.selectExpr("path", "content", "CAST(NULL AS STRING) AS password"), "objects", {})
    batch = pa.RecordBatch.from_pylist([{"path": str(k), "content": data, "password": None} for k in range(50)])
    assert [x.num_rows for x in sent[0](iter([batch]))] == [sizes.count()]


def test_few_rows_are_dealt_to_all_tasks(spark):
    """Files of a table of short rows are made and read by as many tasks as there are shuffle partitions, not by the one that scans it."""
    from quire.plans import file_queries, made_files

    few = made_files.gathered(spark.range(40).selectExpr("id % 20 AS k", "id"), "k", ["id"])
    assert few.rdd.getNumPartitions() == 4 and few.count() == 20
    if os.path.isdir("/root/testdata/sf0.001"):
        assert file_queries._parts_table(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4


def test_ascii85_in_one_go():
    raw = bytes(range(256)) * 3
    for n in range(20):
        data = base64.a85encode(raw[:n] + raw[7:700])
        assert filters.ascii85(data + b"~>") == raw[:n] + raw[7:700]
    assert filters.ascii85(b"zz5l") == bytes(8) + b"A" and filters.ascii85(b"!") == b""
    with pytest.raises(PdfError):
        filters.ascii85(b"abc\x7f")
