"""PDF files made from table rows, in every form that a reader has to cope with.

The emitters here share no code with the package's own writer but the ciphers, so that reading is held against files
that something else wrote. A file is a dictionary of object numbers to bodies; object 1 is the catalog.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.pdf import crypt

Objects = dict[int, bytes]


def literal(raw: bytes) -> bytes:
    for c in (b"\\", b"(", b")"):
        raw = raw.replace(c, b"\\" + c)
    return b"(" + raw.replace(b"\r", b"\\r") + b")"


def string(text: str) -> bytes:
    """A text string: UTF-16 with a byte order mark, as hexadecimal digits."""
    return b"<FEFF" + text.encode("utf-16-be").hex().encode() + b">"


def stream(data: bytes, head: str = "") -> bytes:
    return f"<< {head} /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream"


def simple_text(text: str | None, size: int = 12) -> bytes:
    """Content that shows a text line by line, 14 points apart."""
    lines = (text or "").split("\n")
    shown = b" ".join(b"0 -14 Td " + literal(x.encode("cp1252", "replace")) + b" Tj" for x in lines)
    return b"BT /F1 %d Tf 72 734 Td " % size + shown + b" ET"


def paged(contents: Iterable[bytes], font: str = "/Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding", catalog: str = "", page: Callable[[int], str] = lambda k: "") -> Objects:
    """A file of one page for each stream body (see stream()): pages are objects 10, 12, ..., contents 11, 13, ..."""
    contents = list(contents)
    objects = {1: f"<< /Type /Catalog /Pages 2 0 R {catalog} >>".encode(), 3: f"<< {font} >>".encode()}
    kids = " ".join(f"{10 + 2 * k} 0 R" for k in range(len(contents)))
    objects[2] = f"<< /Type /Pages /Kids [{kids}] /Count {len(contents)} /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> >>".encode()
    for k, body in enumerate(contents):
        objects[10 + 2 * k] = f"<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * k} 0 R {page(k)} >>".encode()
        objects[11 + 2 * k] = body
    return objects


def _bodies(out: bytearray, objects: Objects) -> dict[int, int]:
    places = {}
    for num, body in objects.items():
        places[num] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (num, body)
    return places


def _classic_table(places: dict[int, int], free: bool) -> bytes:
    rows = (["0 1\n0000000000 65535 f "] if free else []) + [f"{num} 1\n{at:010d} 00000 n " for num, at in sorted(places.items())]
    return ("xref\n" + "\n".join(rows) + "\n").encode()


def classic(objects: Objects, trailer: str = "") -> bytes:
    """A table of offsets at the end, numbers in no order."""
    out = bytearray(b"%PDF-1.4\n")
    places = _bodies(out, dict(sorted(objects.items(), reverse=True)))
    at = len(out)
    out += _classic_table(places, True) + f"trailer\n<< /Size {max(objects) + 1} /Root 1 0 R {trailer} >>\nstartxref\n{at}\n%%EOF\n".encode()
    return bytes(out)


def revised(base: bytes, changes: Objects) -> bytes:
    """A revision behind a file, pointing back to the section before."""
    out = bytearray(base)
    before = int(base[base.rindex(b"startxref") + 9 :].split()[0])
    places = _bodies(out, changes)
    at = len(out)
    out += _classic_table(places, False) + f"trailer\n<< /Size 9999 /Root 1 0 R /Prev {before} >>\nstartxref\n{at}\n%%EOF\n".encode()
    return bytes(out)


def _up(rows: list[bytes]) -> bytes:
    """PNG prediction from the row above."""
    out, above = bytearray(), bytes(len(rows[0]))
    for row in rows:
        out += b"\x02" + bytes((a - b) & 255 for a, b in zip(row, above, strict=True))
        above = row
    return bytes(out)


def _xref_stream(num: int, rows: dict[int, bytes], more: str = "") -> bytes:
    index = " ".join(f"{k} 1" for k in sorted(rows))
    data = zlib.compress(_up([rows[k] for k in sorted(rows)]))
    return stream(data, f"/Type /XRef /W [1 4 2] /Index [{index}] /Size {num + 1} /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 7 >> {more}")


def packed(objects: Objects) -> bytes:
    """Objects that are no streams lie in a compressed object stream, places in a predicted cross-reference stream."""
    held = {n: b for n, b in objects.items() if b"stream\n" not in b}
    own, table = max(objects) + 1, max(objects) + 2
    head, body = [], bytearray()
    for num, value in held.items():
        head.append(f"{num} {len(body)}")
        body += value + b" "
    first = " ".join(head).encode() + b"\n"
    data = zlib.compress(first + bytes(body))
    rest = {n: b for n, b in objects.items() if n not in held} | {own: stream(data, f"/Type /ObjStm /N {len(held)} /First {len(first)} /Filter /FlateDecode")}
    out = bytearray(b"%PDF-1.5\n")
    places = _bodies(out, rest)
    rows = {n: struct.pack(">BIH", 1, at, 0) for n, at in places.items()} | {n: struct.pack(">BIH", 2, own, k) for k, n in enumerate(held)}
    at = len(out)
    rows[table] = struct.pack(">BIH", 1, at, 0)
    out += b"%d 0 obj\n%s\nendobj\n" % (table, _xref_stream(table, rows)) + b"startxref\n%d\n%%%%EOF\n" % at
    return bytes(out)


def hybrid(objects: Objects) -> bytes:
    """A table of offsets for old readers whose trailer points to a cross-reference stream with the rest."""
    hidden = {n: b for n, b in objects.items() if n > 3}
    out = bytearray(b"%PDF-1.5\n")
    places = _bodies(out, objects)
    num, extra = max(objects) + 1, len(out)
    out += b"%d 0 obj\n%s\nendobj\n" % (num, _xref_stream(num, {n: struct.pack(">BIH", 1, places[n], 0) for n in hidden}))
    at = len(out)
    out += _classic_table({n: a for n, a in places.items() if n not in hidden}, True) + f"trailer\n<< /Size {num + 1} /Root 1 0 R /XRefStm {extra} >>\nstartxref\n{at}\n%%EOF\n".encode()
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """Single bytes as codes of nine bits, the table cleared before it grows."""
    bits = "".join(("100000000" if k % 200 == 0 else "") + f"{c:09b}" for k, c in enumerate(data)) + "100000001"
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def tiff(data: bytes, columns: int) -> bytes:
    """Differences along rows of `columns` bytes."""
    out = bytearray()
    for k in range(0, len(data), columns):
        row = data[k : k + columns]
        out += bytes((c - (row[j - 1] if j else 0)) & 255 for j, c in enumerate(row))
    return bytes(out)


def filtered(data: bytes, kind: int) -> bytes:
    """One of seven chains of filters over the data."""
    wide = data + b" " * (-len(data) % 16)
    return [
        lambda: stream(zlib.compress(data), "/Filter /FlateDecode"),
        lambda: stream(data.hex().encode() + b">", "/Filter [/ASCIIHexDecode]"),
        lambda: stream(base64.a85encode(data) + b"~>", "/Filter /A85"),
        lambda: stream(lzw(data), "/Filter /LZWDecode"),
        lambda: stream(base64.a85encode(zlib.compress(data)) + b"~>", "/Filter [/ASCII85Decode /FlateDecode]"),
        lambda: stream(zlib.compress(_up([wide[k : k + 16] for k in range(0, len(wide), 16)])), "/Filter /Fl /DecodeParms << /Predictor 15 /Columns 16 >>"),
        lambda: stream(zlib.compress(tiff(wide, 16)), "/Filter [/FlateDecode] /DecodeParms [<< /Predictor 2 /Columns 16 >>]"),
    ][kind % 7]()


def identity_font(text: str) -> tuple[dict[str, int], Objects]:
    """Two-byte codes for the characters of a text, and a composite font (object 3) that maps them back."""
    codes = {c: k + 1 for k, c in enumerate(sorted(set(text)))}
    lines = [b"<%04X> <%s>" % (k, c.encode("utf-16-be").hex().encode()) for c, k in codes.items()]
    body = b"".join(b"%d beginbfchar\n%s\nendbfchar\n" % (len(lines[k : k + 100]), b"\n".join(lines[k : k + 100])) for k in range(0, len(lines), 100))
    return codes, {
        3: b"<< /Type /Font /Subtype /Type0 /BaseFont /Made /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>",
        4: b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Made /CIDToGIDMap /Identity /DW 500 /W [1 [250 600] 5 9 700] >>",
        5: stream(zlib.compress(b"/CIDInit /ProcSet findresource begin begincmap\n" + body + b"endcmap end"), "/Filter /FlateDecode"),
    }


#: Codes of a fixed length for every symbol: 4 bits for sizes of differences, 8 for runs and sizes.
_DC, _AC = list(range(12)), [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]


#: The cosines of a block, and its places in the order of a file.
_COSINES = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def _diagonals() -> list[int]:
    walk, r, c, up = [], 0, 0, True
    while len(walk) < 64:  # up along a diagonal, then down along the next
        walk.append(r * 8 + c)
        if up and (r == 0 or c == 7):
            r, c, up = (r + 1, c, False) if c == 7 else (r, c + 1, False)
        elif not up and (c == 0 or r == 7):
            r, c, up = (r, c + 1, True) if r == 7 else (r + 1, c, True)
        else:
            r, c = (r - 1, c + 1) if up else (r + 1, c - 1)
    return walk


_WALK = _diagonals()


def jpeg(pixels: np.ndarray, reduced: int = 1, restart: int = 0) -> bytes:
    """A sequential JPEG file of (height, width, 1 or 3) samples, nothing quantised away; components but the first may be
    reduced by a factor. Three components are luminance and two of colour."""
    height, width, n = pixels.shape
    if n == 3:
        r, g, b = (pixels[..., k].astype(float) for k in range(3))
        luma = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [luma, (b - luma) / 1.772 + 128, (r - luma) / 1.402 + 128]
    else:
        planes = [pixels[..., 0].astype(float)]
    factors = [reduced] + [1] * (n - 1)
    units = -(-height // (8 * reduced)), -(-width // (8 * reduced))
    blocks = []
    for plane, factor in zip(planes, factors, strict=True):
        step = reduced // factor
        full = np.pad(plane, ((0, units[0] * 8 * reduced - height), (0, units[1] * 8 * reduced - width)), "edge")
        full = full.reshape(full.shape[0] // step, step, full.shape[1] // step, step).mean(axis=(1, 3)) - 128
        tiles = full.reshape(full.shape[0] // 8, 8, full.shape[1] // 8, 8).swapaxes(1, 2)
        blocks.append(np.round(_COSINES @ tiles @ _COSINES.T).astype(int).reshape(*tiles.shape[:2], 64))
    bits, before, parts = [], [0] * n, []

    def number(value: int, size: int) -> None:
        if size:
            bits.append(f"{value if value > 0 else value + (1 << size) - 1:0{size}b}")

    def close() -> None:
        text = "".join(bits)
        text += "1" * (-len(text) % 8)
        parts.append((int(text, 2).to_bytes(len(text) // 8, "big") if text else b"").replace(b"\xff", b"\xff\x00"))
        bits.clear()

    for unit in range(units[0] * units[1]):
        if restart and unit and unit % restart == 0:
            close()
            before = [0] * n
        y, x = divmod(unit, units[1])
        for k, factor in enumerate(factors):
            for dy in range(factor):
                for dx in range(factor):
                    block = blocks[k][y * factor + dy, x * factor + dx][_WALK].tolist()
                    size = abs(block[0] - before[k]).bit_length()
                    bits.append(f"{size:04b}")
                    number(block[0] - before[k], size)
                    before[k], run = block[0], 0
                    last = max((j for j in range(1, 64) if block[j]), default=0)
                    for value in block[1 : last + 1]:
                        if value == 0:
                            run += 1
                            continue
                        for _ in range(run // 16):
                            bits.append(f"{_AC.index(0xF0):08b}")
                        size = abs(value).bit_length()
                        bits.append(f"{_AC.index(run % 16 << 4 | size):08b}")
                        number(value, size)
                        run = 0
                    if last < 63:
                        bits.append(f"{_AC.index(0):08b}")
    close()

    def segment(marker: int, body: bytes) -> bytes:
        return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body

    frame = bytes([8]) + struct.pack(">HH", height, width) + bytes([n]) + b"".join(bytes([k + 1, f << 4 | f, 0]) for k, f in enumerate(factors))
    codes = segment(0xC4, bytes([0]) + bytes([0, 0, 0, len(_DC)] + [0] * 12) + bytes(_DC)) + segment(0xC4, bytes([0x10]) + bytes([0] * 7 + [len(_AC)] + [0] * 8) + bytes(_AC))
    scan = bytes([n]) + b"".join(bytes([k + 1, 0]) for k in range(n)) + bytes([0, 63, 0])
    body = b"".join(part + (bytes([0xFF, 0xD0 + j % 8]) if j + 1 < len(parts) else b"") for j, part in enumerate(parts))
    return b"\xff\xd8" + segment(0xDB, bytes([0]) + b"\x01" * 64) + segment(0xC0, frame) + (segment(0xDD, restart.to_bytes(2, "big")) if restart else b"") + codes + segment(0xDA, scan) + body + b"\xff\xd9"


def truetype(glyphs: list[bytes], codes: dict[int, int]) -> bytes:
    """A TrueType file of the glyphs (in the form of their table) with a map of characters."""
    places, body = [0], b""
    for glyph in glyphs:
        body += glyph + bytes(-len(glyph) % 4)
        places.append(len(body))
    ends = sorted(codes)
    n = len(ends) + 1
    segments = [*((c, c, (codes[c] - c) & 0xFFFF) for c in ends), (0xFFFF, 0xFFFF, 1)]
    flat = struct.pack(f">{n}H", *(s[1] for s in segments)) + bytes(2) + struct.pack(f">{n}H", *(s[0] for s in segments)) + struct.pack(f">{n}H", *(s[2] for s in segments)) + bytes(2 * n)
    table = struct.pack(">HHHHHHH", 4, 14 + len(flat), 0, 2 * n, 0, 0, 0) + flat
    head = bytes(18) + struct.pack(">H", 1000) + bytes(30) + struct.pack(">hh", 1, 0)
    tables = {b"cmap": struct.pack(">HHHHI", 0, 1, 3, 1, 12) + table, b"glyf": body, b"head": head, b"loca": struct.pack(f">{len(places)}I", *places)}
    out, at = struct.pack(">IHHHH", 0x00010000, len(tables), 0, 0, 0), 12 + 16 * len(tables)
    for tag, data in tables.items():
        out += struct.pack(">4sIII", tag, 0, at, len(data))
        at += len(data)
    return out + b"".join(tables.values())


def shape(*contours: list[tuple[int, int, bool]]) -> bytes:
    """A glyph of closed contours, of points on the curve or off it."""
    points = [p for c in contours for p in c]
    ends, count = [], 0
    for c in contours:
        count += len(c)
        ends.append(count - 1)
    steps = [[b - a for a, b in zip([0, *axis], axis, strict=False)] for axis in ([p[0] for p in points], [p[1] for p in points])]
    return struct.pack(">hhhhh", len(contours), 0, 0, 0, 0) + struct.pack(f">{len(ends)}HH", *ends, 0) + bytes(int(p[2]) for p in points) + b"".join(struct.pack(f">{len(s)}h", *s) for s in steps)


def assembled(*parts: tuple[int, int, int]) -> bytes:
    """A glyph of other glyphs, each moved."""
    return struct.pack(">hhhhh", -1, 0, 0, 0, 0) + b"".join(struct.pack(">HHhh", 3 | (0x20 if k + 1 < len(parts) else 0), *part) for k, part in enumerate(parts))


# encryption

def _pad16(data: bytes) -> bytes:
    n = 16 - len(data) % 16
    return data + bytes([n]) * n


def encrypted(contents: list[bytes], password: bytes, revision: int) -> bytes:
    """A file of pages whose content streams are encrypted: RC4 for revisions 2 and 3, AES-128 for 4, AES-256 for 5 and 6."""
    file_id, owner, salt = hashlib.md5(password + b"id").digest(), hashlib.sha256(b"owner").digest(), hashlib.md5(password).digest()
    vector = hashlib.md5(b"vector").digest()
    objects = paged(contents)
    if revision >= 5:
        key = hashlib.sha256(password + b"key").digest()
        digest = crypt.hardened if revision == 6 else lambda p, s: hashlib.sha256(p + s).digest()
        u = digest(password, salt[:8]) + salt
        ue = crypt.aes_cbc(digest(password, salt[8:16]), bytes(16), key, encrypt=True)
        entry = f"/Filter /Standard /V 5 /R {revision} /Length 256 /P -4 /O <{(owner + salt).hex()}> /U <{u.hex()}> /UE <{ue.hex()}> /OE <{ue.hex()}> /Perms <{bytes(16).hex()}> /CF << /StdCF << /CFM /AESV3 /Length 32 >> >> /StmF /StdCF /StrF /StdCF"
    else:
        size = 5 if revision == 2 else 16
        key = hashlib.md5((password + crypt.PAD)[:32] + owner + (0xFFFFFFFC).to_bytes(4, "little") + file_id).digest()
        for _ in range(50 if revision >= 3 else 0):
            key = hashlib.md5(key[:size]).digest()
        key = key[:size]
        if revision == 2:
            u = crypt.rc4(key, crypt.PAD)
        else:
            u = hashlib.md5(crypt.PAD + file_id).digest()
            for k in range(20):
                u = crypt.rc4(bytes(c ^ k for c in key), u)
            u += bytes(16)
        how = "/V 4 /Length 128 /CF << /StdCF << /CFM /AESV2 /Length 16 >> >> /StmF /StdCF /StrF /StdCF" if revision == 4 else "/V 1" if revision == 2 else "/V 2 /Length 128"
        entry = f"/Filter /Standard {how} /R {revision} /P -4 /O <{owner.hex()}> /U <{u.hex()}>"
    for k, data in enumerate(contents):
        num = 11 + 2 * k
        if revision >= 5:
            data = vector + crypt.aes_cbc(key, vector, _pad16(data), encrypt=True)
        else:
            own = hashlib.md5(key + num.to_bytes(3, "little") + bytes(2) + (b"sAlT" if revision == 4 else b"")).digest()[: min(len(key) + 5, 16)]
            data = vector + crypt.aes_cbc(own, vector, _pad16(data), encrypt=True) if revision == 4 else crypt.rc4(own, data)
        objects[num] = stream(data)
    objects[9] = f"<< {entry} >>".encode()
    return classic(objects, f"/Encrypt 9 0 R /ID [<{file_id.hex()}> <{file_id.hex()}>]")


# signatures

#: A key pair of 1024 bits, made for these files from two primes; it protects nothing.
_E = 65537


def _prime(seed: bytes, bits: int = 512) -> int:
    """The first probable prime from a point that the seed names."""
    n = int.from_bytes(b"".join(hashlib.sha256(seed + bytes([k])).digest() for k in range(bits // 256)), "big") | 1 << (bits - 1) | 1 << (bits - 2) | 1
    while any(n % p == 0 for p in (3, 5, 7, 11, 13, 17, 19, 23, 29)) or (n - 1) % _E == 0 or any(pow(a, n - 1, n) != 1 for a in (2, 3, 5, 7)):
        n += 2
    return n


def key_pair(seed: bytes = b"made") -> tuple[int, int]:
    """(modulus, private exponent)."""
    p, q = _prime(seed + b"p"), _prime(seed + b"q")
    return p * q, pow(_E, -1, (p - 1) * (q - 1))


def _der(tag: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    size = len(body)
    head = bytes([size]) if size < 128 else bytes([0x80 | (size.bit_length() + 7) // 8]) + size.to_bytes((size.bit_length() + 7) // 8, "big")
    return bytes([tag]) + head + body


def _oid(digits: str) -> bytes:
    return _der(6, bytes.fromhex(digits))


def _integer(n: int) -> bytes:
    return _der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


_SHA256, _RSA, _DATA, _SIGNED, _TYPE, _DIGEST, _CN = (_oid(x) for x in ("608648016503040201", "2a864886f70d010101", "2a864886f70d010701", "2a864886f70d010702", "2a864886f70d010903", "2a864886f70d010904", "550403"))


def rsa_sign(data: bytes, modulus: int, private: int) -> bytes:
    """An RSA signature over the SHA-256 digest, padded as PKCS #1 version 1.5 has it."""
    size = (modulus.bit_length() + 7) // 8
    info = _der(0x30, _der(0x30, _SHA256, _der(5)), _der(4, hashlib.sha256(data).digest()))
    block = b"\x00\x01" + b"\xff" * (size - 3 - len(info)) + b"\x00" + info
    return pow(int.from_bytes(block, "big"), private, modulus).to_bytes(size, "big")


def signed_data(signed: bytes, common_name: str, attributes: bool, keys: tuple[int, int]) -> bytes:
    """A detached signature with a certificate of that name, over the data or over attributes that hold its digest."""
    modulus, private = keys
    name = _der(0x30, _der(0x31, _der(0x30, _CN, _der(0x0C, common_name.encode()))))
    times = _der(0x30, _der(0x17, b"200101000000Z"), _der(0x17, b"400101000000Z"))
    public = _der(0x30, _der(0x30, _RSA, _der(5)), _der(3, b"\x00", _der(0x30, _integer(modulus), _integer(_E))))
    tbs = _der(0x30, _der(0xA0, _integer(2)), _integer(7), _der(0x30, _RSA, _der(5)), name, times, name, public)
    certificate = _der(0x30, tbs, _der(0x30, _RSA, _der(5)), _der(3, b"\x00" + bytes(8)))
    held = b"".join((_der(0x30, _TYPE, _der(0x31, _DATA)), _der(0x30, _DIGEST, _der(0x31, _der(4, hashlib.sha256(signed).digest())))))
    over = _der(0x31, held) if attributes else signed
    signer = _der(0x30, _integer(1), _der(0x30, name, _integer(7)), _der(0x30, _SHA256, _der(5)), *([_der(0xA0, held)] if attributes else []), _der(0x30, _RSA, _der(5)), _der(4, rsa_sign(over, modulus, private)))
    return _der(0x30, _SIGNED, _der(0xA0, _der(0x30, _integer(1), _der(0x31, _der(0x30, _SHA256, _der(5))), _der(0x30, _DATA), _der(0xA0, certificate), _der(0x31, signer))))


def signed_file(text: str, signer: str, reason: str, keys: tuple[int, int], attributes: bool = True) -> bytes:
    """A file whose one signature field covers all of it but the signature itself."""
    room = 2048
    objects = paged([stream(simple_text(text))], catalog="/AcroForm << /Fields [5 0 R] >>")
    objects[5] = b"<< /FT /Sig /T (sign) /V 6 0 R /Rect [0 0 0 0] >>"
    objects[6] = b"<< /Type /Sig /Filter /Adobe.PPKLite /Name " + string(signer) + b" /Reason " + string(reason) + b" /M (D:20200101) /ByteRange [0 0000000000 0000000000 0000000000] /Contents <" + b"0" * room + b"> >>"
    data = bytearray(classic(objects))
    hole = data.index(b"/Contents <" + b"0" * room) + len(b"/Contents ")
    end = hole + room + 2
    ranges = b"/ByteRange [0 %010d %010d %010d]" % (hole, end, len(data) - end)
    at = data.index(b"/ByteRange")
    data[at : at + len(ranges)] = ranges
    signature = signed_data(bytes(data[:hole] + data[end:]), signer, attributes, keys)
    data[hole + 1 : hole + 1 + 2 * len(signature)] = signature.hex().encode()
    return bytes(data)


# files from tables

def files(rows: DataFrame, make: Callable[[dict[str, Any]], bytes], key: str) -> DataFrame:
    """(path, content) of one file for each row; make gets the row as a dictionary. The path is the key's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                made = batch.slice(begin, 64).to_pylist()
                yield pa.RecordBatch.from_pydict({"path": pa.array([str(r[key]) for r in made], pa.string()), "content": pa.array([make(r) for r in made], pa.binary())})

    return rows.mapInArrow(run, "path string, content binary")


def gathered(rows: DataFrame, key: str, order: list[str], *columns: str) -> DataFrame:
    """key and rows, an array of structs in order: what one file is made of. Making and reading files takes far longer than
    their rows' few bytes say, so they are dealt to all shuffle partitions, which adaptive execution leaves alone."""
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in columns if c not in order)))).alias("rows"))
