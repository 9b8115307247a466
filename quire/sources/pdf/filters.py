"""Stream filters and predictors."""

from __future__ import annotations

import re
import zlib
from typing import Any

import numpy as np

from quire.sources.pdf import jpeg
from quire.sources.pdf.cos import PdfError, Stream

MAX_DECODED = 1 << 30


def ascii_hex(data: bytes) -> bytes:
    digits = re.sub(rb"[\x00\t\n\x0c\r ]", b"", data.partition(b">")[0])
    if not re.fullmatch(rb"[0-9A-Fa-f]*", digits):
        raise PdfError("FilterError", "ASCIIHex digit")
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


POWERS = 85 ** np.arange(4, -1, -1, dtype=np.int64)


def ascii85(data: bytes) -> bytes:
    data = re.sub(rb"[\x00\t\n\x0c\r ]", b"", data).removeprefix(b"<~").partition(b"~")[0]
    if b"z" not in data:
        digits = np.frombuffer(data, np.uint8)
        if len(digits) and not 33 <= digits.min() <= digits.max() <= 117:
            raise PdfError("FilterError", "ASCII85 digit")
        lack = -len(digits) % 5
        groups = np.append(digits - 33, np.full(lack, 84, np.uint8)).reshape(-1, 5) @ POWERS
        return (groups & 0xFFFFFFFF).astype(">u4").tobytes()[: len(groups) * 4 - lack]
    out, group = bytearray(), []
    for c in data:
        if c == 0x7A and not group:
            out += bytes(4)
            continue
        if not 33 <= c <= 117:
            raise PdfError("FilterError", "ASCII85 digit")
        group.append(c - 33)
        if len(group) == 5:
            out += (sum(d * 85 ** (4 - k) for k, d in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
            group = []
    if len(group) > 1:
        n = len(group) - 1
        padded = group + [84] * (5 - len(group))
        out += (sum(d * 85 ** (4 - k) for k, d in enumerate(padded)) & 0xFFFFFFFF).to_bytes(4, "big")[:n]
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits; 256 clears, 257 ends; widths change one code early."""
    table = [bytes([k]) for k in range(256)] + [b"", b""]
    out, width, last, bits, held = bytearray(), 9, b"", 0, 0
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise PdfError("FilterError", "LZW code")
        out += entry
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        last = entry
        width = 9 + (len(table) + 1 >= 512) + (len(table) + 1 >= 1024) + (len(table) + 1 >= 2048)
    return bytes(out)


def flate(data: bytes) -> bytes:
    engine = zlib.decompressobj()
    try:
        out = engine.decompress(data, MAX_DECODED)
    except zlib.error as error:
        raise PdfError("FilterError", str(error)) from None
    if not engine.eof:
        raise PdfError("FilterError", "truncated or too large")
    return out


def unpredict(data: bytes, parms: dict[str, Any]) -> bytes:
    kind, colors, columns, depth = parms.get("Predictor", 1), parms.get("Colors", 1), parms.get("Columns", 1), parms.get("BitsPerComponent", 8)
    if kind < 2:
        return data
    bpp, stride = max(1, colors * depth // 8), (colors * depth * columns + 7) // 8
    if kind == 2:
        if len(data) % stride:
            raise PdfError("FilterError", "TIFF predictor row")
        rows = np.frombuffer(data, np.uint8).reshape(-1, stride // bpp, bpp)
        return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes()
    if len(data) % (stride + 1):
        raise PdfError("FilterError", "PNG predictor row")
    above, out = np.zeros(stride, np.uint8), []
    for row in np.frombuffer(data, np.uint8).reshape(-1, stride + 1):
        how, cur = int(row[0]), row[1:].copy()
        if how == 1:
            for k in range(bpp):
                cur[k::bpp] = np.cumsum(cur[k::bpp], dtype=np.uint8)
        elif how == 2:
            cur += above
        elif how in (3, 4):
            values, up = cur.tolist(), above.tolist()
            for k in range(stride):
                a, b, c = (values[k - bpp] if k >= bpp else 0), up[k], (up[k - bpp] if k >= bpp else 0)
                guess = (a + b) // 2 if how == 3 else min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                values[k] = (values[k] + guess) & 0xFF
            cur = np.array(values, np.uint8)
        elif how:
            raise PdfError("FilterError", "PNG predictor kind")
        out.append(cur)
        above = cur
    return b"".join(x.tobytes() for x in out)


DECODERS = {"FlateDecode": flate, "Fl": flate, "ASCIIHexDecode": ascii_hex, "AHx": ascii_hex, "ASCII85Decode": ascii85, "A85": ascii85, "LZWDecode": lzw, "LZW": lzw, "DCTDecode": lambda data: jpeg.decode(data).tobytes(), "DCT": lambda data: jpeg.decode(data).tobytes()}


def decode(stream: Stream, get=lambda x: x) -> bytes:
    """All filters in turn, each with its own predictor; get resolves references."""
    names, parms = get(stream.dict.get("Filter")), get(stream.dict.get("DecodeParms"))
    names = names if isinstance(names, list) else [] if names is None else [names]
    parms = parms if isinstance(parms, list) else [parms]
    data = stream.raw
    for k, name in enumerate(names):
        name = get(name)
        if name not in DECODERS:
            raise PdfError("UnsupportedFilter", str(name))
        own = get(parms[k]) if k < len(parms) else None
        data = unpredict(DECODERS[name](data), own if isinstance(own, dict) else {})
    return data


def jpeg_size(data: bytes) -> tuple[int, int, int]:
    """Width, height and components from the frame header alone."""
    pos = 2
    while pos + 9 < len(data) and data[pos] == 0xFF:
        marker, size = data[pos + 1], int.from_bytes(data[pos + 2 : pos + 4], "big")
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[pos + 7 : pos + 9], "big"), int.from_bytes(data[pos + 5 : pos + 7], "big"), data[pos + 9]
        pos += 2 + size
    raise PdfError("BadImage", "no JPEG frame header")
