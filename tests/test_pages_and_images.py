import hashlib

import numpy as np
import pytest

from quire.__main__ import main
from quire.plans import made_files as M
from quire.sources.pdf import jpeg, raster, signatures
from quire.sources.pdf.cos import PdfError
from quire.sources.pdf.document import Document
from quire.sources.pdf.fonts import standard_widths
from quire.sources.pdf.truetype import TrueType
from quire.sources.pdf.write import Session


def inside(point, outlines, even_odd):
    """Winding of a point by counting the edges to its right."""
    winding = 0
    for p in outlines:
        for (ax, ay), (bx, by) in zip(p, np.roll(p, -1, axis=0), strict=True):
            if (ay <= point[1]) != (by <= point[1]) and ax + (point[1] - ay) * (bx - ax) / (by - ay) <= point[0]:
                winding += 1 if by > ay else -1
    return winding % 2 != 0 if even_odd else winding != 0


@pytest.mark.parametrize("even_odd", [False, True])
def test_coverage_matches_brute_force(even_odd):
    rng = np.random.default_rng(4)
    outlines = [rng.uniform(-3, 15, (6, 2)), rng.uniform(2, 9, (5, 2))]
    rows, columns, share = raster.coverage(outlines, even_odd, 12, 11)
    want = np.zeros((11, 12))
    for y in range(44):
        for x in range(48):
            want[y // 4, x // 4] += inside(((x + 0.5) / 4, (y + 0.5) / 4), outlines, even_odd) / 16
    found = np.zeros((11, 12))
    found[rows, columns] = share
    assert np.array_equal(found, want)
    assert raster.coverage([np.array([[20.0, 20], [30, 20], [30, 30]])], even_odd, 12, 11) is None


def painted(content, box="0 0 20 10", page="", scale=1.0, turn=0):
    objects = M.paged([M.stream(content)], page=lambda _: page)
    objects[2] = objects[2].replace(b"0 0 612 792", box.encode())
    doc = Document(M.classic(objects))
    return raster.render(doc, doc.pages()[0], scale, turn)


def test_painting():
    assert (painted(b"") == 255).all() and painted(b"", scale=2.5, turn=90).shape == (50, 25, 4)
    red = painted(b"1 0 0 rg 5 2 4 3 re f")
    assert (red[5:8, 5:9, :3] == (255, 0, 0)).all() and (red[..., 1] == 0).sum() == 12
    turned = painted(b"1 0 0 rg 5 2 4 3 re f", page="/Rotate 90")
    assert turned.shape == (20, 10, 4) and (turned[5:9, 2:5, 1] == 0).all() and (turned[..., 1] == 0).sum() == 12
    corner = painted(b"0 0 0 RG 2 w 3 3 m 10 3 l 10 8 l S")
    assert (corner[6:8, 3:11, 0] == 0).all() and (corner[2:8, 9:11, 0] == 0).all()  # the miter fills the corner
    half = painted(b"q 5 2 2 3 re W n 1 0 0 rg 5 2 4 3 re f Q 0 1 0 rg 0 0 1 1 re f")
    assert (half[..., 1] == 0).sum() == 6 and (half[9, 0, :3] == (0, 255, 0)).all()
    assert (painted(b"0 0 0 1 k 0 0 20 10 re f")[..., :3] == 0).all()
    ring = painted(b"0 g 2 2 6 6 re 4 4 2 2 re f*")
    assert (ring[..., 0] == 0).sum() == 32
    with pytest.raises(PdfError, match="TooLarge"):
        painted(b"", scale=1e6)


def test_render_command(tmp_path):
    source, out = tmp_path / "a.pdf", tmp_path / "a.png"
    source.write_bytes(M.classic(M.paged([M.stream(b"0 0 9 9 re f")])))
    assert main(["render", str(source), str(out)]) == 0 and out.read_bytes().startswith(b"\x89PNG")
    assert main(["render", str(source), str(out), "7"]) == 1


@pytest.mark.parametrize("reduced", [1, 2])
@pytest.mark.parametrize("restart", [0, 3])
def test_jpeg(reduced, restart):
    y, x = np.mgrid[0:37, 0:53]
    smooth = np.stack([128 + 100 * np.sin(x / 19 + k) * np.cos(y / (17 + k)) for k in range(3)], axis=2).astype(np.uint8)
    grey = np.random.default_rng(1).integers(0, 256, (37, 53, 1)).astype(np.uint8)
    assert np.abs(jpeg.decode(M.jpeg(grey, 1, restart)).astype(int) - grey).max() <= 1
    assert np.abs(jpeg.decode(M.jpeg(smooth, reduced, restart)).astype(int) - smooth).max() <= (2 if reduced == 1 else 8)
    for bad in (b"", b"\xff\xd8\xff\xd9", M.jpeg(grey)[:300], M.jpeg(grey)[:900]):
        with pytest.raises(PdfError):
            jpeg.decode(bad)


def progressive(pixels):
    """A progressive JPEG file of grey samples: bits of coefficients in six scans, two of them and one more refining others."""
    height, width = pixels.shape
    walk = jpeg.ZIGZAG
    shown = np.pad(pixels.astype(float), ((0, -height % 8), (0, -width % 8)), "edge") - 128
    tiles = shown.reshape(shown.shape[0] // 8, 8, -1, 8).swapaxes(1, 2)
    blocks = np.round(jpeg._WAVES @ tiles @ jpeg._WAVES.T).astype(int).reshape(-1, 64)[:, walk].tolist()
    bits = []

    def number(value, size):
        if size:
            bits.append(f"{value if value > 0 else value + (1 << size) - 1:0{size}b}")

    def symbol(value):
        bits.append(f"{M._AC.index(value):08b}")

    def scan(first, last, high, low):
        bits.clear()
        before = 0
        for block in blocks:
            if first == 0 and high:
                bits.append(str(block[0] >> low & 1))
            elif first == 0:
                step = (block[0] >> low) - before
                before = block[0] >> low
                bits.append(f"{abs(step).bit_length():04b}")
                number(step, abs(step).bit_length())
            else:
                values = [(abs(c) >> low) * (1 if c > 0 else -1) for c in block]
                fresh = [k for k in range(first, last + 1) if (abs(values[k]) == 1 if high else values[k])]
                run, held = 0, []
                for k in range(first, last + 1):
                    v = values[k]
                    if v == 0:
                        run += 1
                        continue
                    while run > 15 and k <= max(fresh, default=0):
                        symbol(0xF0)
                        bits.extend(held)
                        held, run = [], run - 16
                    if high and abs(v) > 1:
                        held.append(str(abs(v) & 1))
                        continue
                    size = abs(v).bit_length()
                    symbol(run << 4 | size)
                    number(v, size)
                    bits.extend(held)
                    held, run = [], 0
                if run or held:
                    symbol(0)
                    bits.extend(held)
        text = "".join(bits)
        text += "1" * (-len(text) % 8)
        data = int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00")
        return b"\xff\xda\x00\x08\x01\x01\x00" + bytes([first, last, high << 4 | low]) + data

    base = M.jpeg(pixels[..., None])
    head = base[: base.index(b"\xff\xda")].replace(b"\xff\xc0", b"\xff\xc2")
    return head + b"".join(scan(*x) for x in ((0, 0, 0, 1), (1, 5, 0, 2), (6, 63, 0, 2), (1, 63, 2, 1), (0, 0, 1, 0), (1, 63, 1, 0))) + b"\xff\xd9"


@pytest.mark.parametrize("kind", ["noise", "smooth"])
def test_progressive_jpeg(kind):
    y, x = np.mgrid[0:29, 0:43]
    pixels = (np.random.default_rng(2).integers(0, 256, (29, 43)) if kind == "noise" else 128 + 90 * np.sin(x / 7) * np.cos(y / 9)).astype(np.uint8)
    assert np.abs(jpeg.decode(progressive(pixels))[..., 0].astype(int) - pixels).max() <= 1


def test_truetype_curves():
    """The area between a curve and its chord is two thirds of the triangle with the control point."""
    glyphs = [b"", M.shape([(0, 0, True), (0, 1000, False), (1000, 1000, True)]), M.shape([(0, 0, False), (0, 1000, False), (1000, 1000, False), (1000, 0, False)]), M.shape([(0, 0, True)])[:9]]
    face = TrueType(M.truetype(glyphs, {65: 1, 0x1234: 2}))
    assert face.glyph_of(65, "A") == 1 and face.glyph_of(1, "\u1234") == 2 and face.glyph_of(66, "B") == 0

    def area(glyph):
        _, _, share = raster.coverage([p for p, _ in raster.polygons(face.outline(glyph), (0.2, 0, 0, 0.2, 0, 0))], False, 200, 200)
        return share.sum() / 200**2

    assert area(1) == pytest.approx(1 / 3, abs=0.01)
    assert area(2) == pytest.approx(0.5 + 4 / 12, abs=0.01)  # a diamond between middles and four curves over its sides
    assert face.outline(0) == face.outline(3) == face.outline(99) == []


def test_signature_blocks():
    modulus, private = keys = M.key_pair()
    data = b"signed"
    for attributes in (True, False):
        good = M.signed_data(data, "Test Signer", attributes, keys)
        assert signatures.verify(data, good) == ("Valid", "Test Signer")
        assert signatures.verify(data + b"!", good)[0] == "ContentModified"
        assert signatures.verify(data, good[:-9])[0] == "Malformed"
    # a block that starts and ends well but is no padding in between
    size = (modulus.bit_length() + 7) // 8
    digest = hashlib.sha256(data).digest()
    forged = b"\x00\x01\xff\xff\x00" + bytes(size - 5 - len(digest)) + digest
    raw = pow(int.from_bytes(forged, "big"), private, modulus).to_bytes(size, "big")
    good = M.signed_data(data, "Test Signer", False, keys)
    assert signatures.verify(data, good.replace(M.rsa_sign(data, *keys), raw))[0] != "Valid"
    for n in range(4000):  # a digest that holds what also ends the padding
        if b"\xff\x00" in hashlib.sha256(b"%d" % n).digest():
            assert signatures.verify(b"%d" % n, M.signed_data(b"%d" % n, "T", False, keys))[0] == "Valid"
            break


def test_standard_widths():
    assert [standard_widths(f)[65] for f in ("Helvetica", "AAAAAA+Helvetica-Bold", "Helvetica-Oblique", "Times-Roman", "Times-Bold", "Times-Italic", "Times-BoldItalic", "Courier-Bold")] == [667, 722, 667, 722, 722, 611, 667, 600]
    own = standard_widths("Helvetica")
    assert own[0xEF] == own[ord("i")] == 222 and own[0xC0] == 667 and own[0x97] == 1000 and own[0x93] == 333


def test_pending_pages_are_not_written_to_be_read():
    session = Session(M.classic(M.paged(M.stream(M.simple_text(str(k))) for k in range(4))))
    session.move(0, 3)
    session.insert_blank(1)
    assert [p.ref for p in Document(session.save()).pages()] == session.page_refs() and len(session.page_refs()) == 5
    assert [p.ref.num for p in session.doc.pages()] == [10, 12, 14, 16]


def test_upright_boxes_cover_as_other_shapes():
    """A box by itself takes a short way; the same box beside an empty shape takes the general one."""
    rng = np.random.default_rng(5)
    for k in range(200):
        x0, x1, y0, y1 = rng.integers(-12, 60, 4) / 4 if k % 2 else rng.uniform(-3, 15, 4)
        box = np.roll(np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)]), k, axis=0)
        short, known = (raster.coverage(p, False, 12, 11) for p in ([box], [box, box[:1]]))
        assert (short is None) == (known is None)
        assert short is None or short[:2] == known[:2] and np.array_equal(short[2], known[2])


def test_code_tables_are_made_once():
    counts = bytes([0, 1, 5]) + bytes(13)
    assert jpeg.huffman(counts, bytes(range(6))) is jpeg.huffman(counts, bytes(range(6)))
