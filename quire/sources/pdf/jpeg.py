"""JPEG files to samples: sequential and progressive Huffman scans of 8 bits.

Scans fill the coefficients of each component; what follows (dequantisation, the inverse cosine transform, widening of
reduced components, colours) runs over whole arrays.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np

from quire.sources.pdf.cos import PdfError

#: Places of coefficients in the order of a file: diagonals of a block of 8 by 8, up and down in turn.
ZIGZAG = [r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[1] if (p[0] + p[1]) % 2 == 0 else p[0]))]
_WAVES = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
MAX_SAMPLES = 1 << 28


@dataclass
class Component:
    """Sampling, tables and coefficients; rows and columns count blocks, the padding of the last unit included."""

    across: int
    down: int
    quantiser: int
    rows: int = 0
    columns: int = 0
    used_rows: int = 0
    used_columns: int = 0
    blocks: list[list[int]] = field(default_factory=list)


@functools.lru_cache(16)
def huffman(counts: bytes, symbols: bytes) -> list[int]:
    """Not to be changed, as files share tables. For every 16 bits ahead: symbol and length of the code that they begin with, as symbol << 5 | length; 0 for none."""
    table, code, k = [0] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            first, width = code << (16 - length), 1 << (16 - length)
            if first + width > 65536 or k >= len(symbols):
                raise PdfError("BadImage", "JPEG code table")
            table[first : first + width] = [symbols[k] << 5 | length] * width
            code, k = code + 1, k + 1
        code <<= 1
    return table


class Bits:
    """The entropy-coded bytes between two markers."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(8), 0, 8 * len(data) + 64

    def symbol(self, table: list[int]) -> int:
        i = self.at >> 3
        d = self.data
        if self.at + 24 > self.end:
            raise PdfError("BadImage", "JPEG data ends early")
        found = table[((d[i] << 16 | d[i + 1] << 8 | d[i + 2]) >> (8 - (self.at & 7))) & 0xFFFF]
        if not found:
            raise PdfError("BadImage", "JPEG code")
        self.at += found & 31
        return found >> 5

    def number(self, n: int) -> int:
        if n == 0:
            return 0
        i = self.at >> 3
        d = self.data
        if self.at + 32 > self.end + 32:
            raise PdfError("BadImage", "JPEG data ends early")
        value = ((d[i] << 24 | d[i + 1] << 16 | d[i + 2] << 8 | d[i + 3]) >> (32 - (self.at & 7) - n)) & ((1 << n) - 1)
        self.at += n
        return value

    def signed(self, n: int) -> int:
        value = self.number(n)
        return value if n == 0 or value >> (n - 1) else value - (1 << n) + 1


class Scan:
    """One scan: which coefficients of which components it brings, and at which precision."""

    def __init__(self, parts: list[tuple[Component, list[int] | None, list[int] | None]], first: int, last: int, high: int, low: int, progressive: bool):
        self.parts, self.first, self.last, self.high, self.low, self.progressive = parts, first, last, high, low, progressive
        self.restart()

    def restart(self) -> None:
        self.before, self.ended = [0] * len(self.parts), 0

    def block(self, bits: Bits, k: int, block: list[int]) -> None:
        _, dc, ac = self.parts[k]
        if not self.progressive:
            self._dc(bits, k, dc, block)
            self._ac(bits, ac, block, 1, 63)
        elif self.first == 0:
            if self.high:
                block[0] |= bits.number(1) << self.low
            else:
                self._dc(bits, k, dc, block)
        elif self.high:
            self._refine(bits, ac, block)
        else:
            self._ac(bits, ac, block, self.first, self.last)

    def _dc(self, bits: Bits, k: int, table: list[int], block: list[int]) -> None:
        self.before[k] += bits.signed(bits.symbol(table))
        block[0] = self.before[k] << self.low

    def _ac(self, bits: Bits, table: list[int], block: list[int], at: int, last: int) -> None:
        if self.ended:
            self.ended -= 1
            return
        while at <= last:
            symbol = bits.symbol(table)
            run, size = symbol >> 4, symbol & 15
            if size == 0:
                if run < 15:
                    self.ended = (1 << run) + bits.number(run) - 1
                    return
                at += 16
                continue
            at += run
            if at > 63:
                raise PdfError("BadImage", "JPEG coefficient")
            block[ZIGZAG[at]] = bits.signed(size) << self.low
            at += 1

    def _refine(self, bits: Bits, table: list[int], block: list[int]) -> None:
        at, one = self.first, 1 << self.low

        def sharpen(place: int) -> None:
            if bits.number(1) and not abs(block[place]) & one:
                block[place] += one if block[place] > 0 else -one

        if not self.ended:
            while at <= self.last:
                symbol = bits.symbol(table)
                run, size = symbol >> 4, symbol & 15
                new = 0
                if size:
                    new = one if bits.number(1) else -one
                elif run < 15:
                    self.ended = (1 << run) + bits.number(run)
                    break
                while at <= self.last:
                    place = ZIGZAG[at]
                    if block[place]:
                        sharpen(place)
                    else:
                        if run == 0:
                            if new:
                                block[place] = new
                            at += 1
                            break
                        run -= 1
                    at += 1
        if self.ended:
            while at <= self.last:
                if block[ZIGZAG[at]]:
                    sharpen(ZIGZAG[at])
                at += 1
            self.ended -= 1


def _segments(data: bytes, at: int) -> tuple[list[bytes], int]:
    """Entropy-coded bytes from a place on, cut at restart markers, and where the next marker stands."""
    out, begin = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            at = len(data)
            break
        follows = data[at + 1]
        if follows == 0 or follows == 0xFF:
            at += 2 - (follows == 0xFF)
        elif 0xD0 <= follows <= 0xD7:
            out.append(data[begin:at])
            at += 2
            begin = at
        else:
            break
    out.append(data[begin:at])
    return [x.replace(b"\xff\x00", b"\xff") for x in out], at


def _run(scan: Scan, segments: list[bytes], interval: int, widest: tuple[int, int], units: tuple[int, int]) -> None:
    single = len(scan.parts) == 1
    if single:
        part = scan.parts[0][0]
        order = [[(0, r * part.columns + c)] for r in range(part.used_rows) for c in range(part.used_columns)]
    else:
        order = [[(k, (y * p.down + dy) * p.columns + x * p.across + dx) for k, (p, _, _) in enumerate(scan.parts) for dy in range(p.down) for dx in range(p.across)] for y in range(units[1]) for x in range(units[0])]
    step = interval or len(order)
    for begin, data in zip(range(0, len(order), step), segments, strict=False):
        scan.restart()
        bits = Bits(data)
        for unit in order[begin : begin + step]:
            for k, n in unit:
                scan.block(bits, k, scan.parts[k][0].blocks[n])


def decode(data: bytes) -> np.ndarray:
    """Samples as (height, width, components): grey, RGB, or CMYK as printers count it (0 is no ink)."""
    if data[:2] != b"\xff\xd8":
        raise PdfError("BadImage", "no JPEG file")
    quantisers: dict[int, np.ndarray] = {}
    tables: dict[int, list[int]] = {}
    parts: dict[int, Component] = {}
    at, interval, adobe, progressive, scans = 2, 0, None, False, 0
    width = height = 0
    widest, units = (1, 1), (0, 0)
    try:
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            marker = data[at + 1]
            if marker == 0xFF or 0xD0 <= marker <= 0xD8 or marker == 1 or marker == 0:
                at += 1 if marker == 0xFF else 2
                continue
            if marker == 0xD9:
                break
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 128 if wide else 64
                    table = np.zeros(64)
                    table[ZIGZAG] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8)
                    quantisers[body[0] & 15] = table
                    body = body[1 + n :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    tables[body[0]] = huffman(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker in (0xC0, 0xC1, 0xC2):
                progressive = marker == 0xC2
                height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                if body[0] != 8 or not width or not height or width * height * body[5] > MAX_SAMPLES:
                    raise PdfError("UnsupportedImage", "JPEG of other than 8 bits or of no size")
                for k in range(body[5]):
                    name, factors, quantiser = body[6 + 3 * k : 9 + 3 * k]
                    if not factors >> 4 or not factors & 15:
                        raise PdfError("BadImage", "JPEG sampling factors")
                    parts[name] = Component(factors >> 4, factors & 15, quantiser)
                widest = max(p.across for p in parts.values()), max(p.down for p in parts.values())
                units = -(-width // (8 * widest[0])), -(-height // (8 * widest[1]))
                for p in parts.values():
                    p.columns, p.rows = units[0] * p.across, units[1] * p.down
                    p.used_columns, p.used_rows = -(-(-(-width * p.across // widest[0])) // 8), -(-(-(-height * p.down // widest[1])) // 8)
                    p.blocks = [[0] * 64 for _ in range(p.columns * p.rows)]
            elif 0xC3 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise PdfError("UnsupportedImage", "JPEG that is lossless or arithmetic")
            elif marker == 0xDD:
                interval = int.from_bytes(body[:2], "big")
            elif marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
                adobe = body[11]
            elif marker == 0xDA:
                n = body[0]
                chosen = [(parts[body[1 + 2 * k]], tables.get(body[2 + 2 * k] >> 4), tables.get(0x10 | body[2 + 2 * k] & 15)) for k in range(n)]
                first, last, precision = body[1 + 2 * n : 4 + 2 * n]
                scan = Scan(chosen, first if progressive else 0, last if progressive else 63, precision >> 4 if progressive else 0, precision & 15 if progressive else 0, progressive)
                segments, at = _segments(data, at)
                _run(scan, segments, interval, widest, units)
                scans += 1
        if not scans:
            raise PdfError("BadImage", "no JPEG scan")
        planes = [_plane(p, quantisers[p.quantiser], widest)[:height, :width] for p in parts.values()]
    except (IndexError, KeyError, ValueError, TypeError) as error:
        raise PdfError("BadImage", f"JPEG: {type(error).__name__}") from None
    return _colours(np.stack(planes, axis=2), adobe)


def _plane(part: Component, quantiser: np.ndarray, widest: tuple[int, int]) -> np.ndarray:
    blocks = (np.array(part.blocks, float) * quantiser).reshape(-1, 8, 8)
    shown = _WAVES.T @ blocks @ _WAVES + 128
    plane = shown.reshape(part.rows, part.columns, 8, 8).swapaxes(1, 2).reshape(part.rows * 8, part.columns * 8)
    return plane.repeat(widest[1] // part.down, axis=0).repeat(widest[0] // part.across, axis=1)


def _colours(planes: np.ndarray, adobe: int | None) -> np.ndarray:
    n = planes.shape[2]
    if n in (3, 4) and (adobe in (1, 2) or n == 3 and adobe is None):
        y, cb, cr = planes[..., 0], planes[..., 1] - 128, planes[..., 2] - 128
        planes = np.concatenate((np.stack((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb), axis=2), planes[..., 3:]), axis=2)
    out = np.clip(np.floor(planes + 0.5), 0, 255).astype(np.uint8)
    return 255 - out if n == 4 and adobe is not None else out
