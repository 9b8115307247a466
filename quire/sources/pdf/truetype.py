"""Outlines of embedded TrueType fonts."""

from __future__ import annotations

import struct

Point = tuple[float, float]
MAX_PARTS = 8


class TrueType:
    """A font file's glyphs by number and its maps from codes to them; what is broken has no outline."""

    def __init__(self, data: bytes):
        count = struct.unpack_from(">H", data, 4)[0]
        entries = (struct.unpack_from(">4sIII", data, 12 + 16 * k) for k in range(count))
        self.tables = {tag: data[at : at + size] for tag, _, at, size in entries}
        head = self.tables[b"head"]
        self.units = struct.unpack_from(">H", head, 18)[0] or 1000
        self.long, self.loca, self.glyf = struct.unpack_from(">h", head, 50)[0], self.tables[b"loca"], self.tables[b"glyf"]
        self.maps = self._maps(self.tables.get(b"cmap", b""))
        self.cache: dict[int, list[tuple]] = {}

    def _maps(self, table: bytes) -> dict[tuple[int, int], dict[int, int]]:
        out = {}
        for k in range(struct.unpack_from(">H", table, 2)[0] if len(table) > 4 else 0):
            platform, encoding, at = struct.unpack_from(">HHI", table, 4 + 8 * k)
            try:
                out[platform, encoding] = self._map(table[at:])
            except (struct.error, IndexError):
                continue
        return out

    @staticmethod
    def _map(table: bytes) -> dict[int, int]:
        kind = struct.unpack_from(">H", table)[0]
        if kind == 0:
            return {c: g for c, g in enumerate(table[6:262]) if g}
        if kind == 6:
            first, count = struct.unpack_from(">HH", table, 6)
            return {first + k: g for k, g in enumerate(struct.unpack_from(f">{count}H", table, 10)) if g}
        out: dict[int, int] = {}
        if kind == 12:
            for k in range(struct.unpack_from(">I", table, 12)[0]):
                first, last, glyph = struct.unpack_from(">III", table, 16 + 12 * k)
                out |= {c: glyph + c - first for c in range(first, min(last, first + 0xFFFF) + 1)}
        elif kind == 4:
            n = struct.unpack_from(">H", table, 6)[0] // 2
            ends, starts, deltas, offsets = (struct.unpack_from(f">{n}H", table, 14 + 2 * n * k + (2 if k else 0)) for k in range(4))
            for k, (first, last) in enumerate(zip(starts, ends, strict=True)):
                for code in range(first, min(last, 0xFFFE) + 1):
                    glyph = code if not offsets[k] else struct.unpack_from(">H", table, 16 + 6 * n + 2 * k + offsets[k] + 2 * (code - first))[0]
                    if glyph or not offsets[k]:
                        out[code] = (glyph + deltas[k]) & 0xFFFF
        return out

    def glyph_of(self, code: int, text: str | None) -> int:
        """The glyph of a simple font's code: by its character, or by the code itself in the ways that such fonts have."""
        if text and len(text) == 1 and (found := self.maps.get((3, 1), self.maps.get((0, 3), {})).get(ord(text))):
            return found
        symbols, roman = self.maps.get((3, 0), {}), self.maps.get((1, 0), {})
        return symbols.get(0xF000 + code) or symbols.get(code) or roman.get(code) or 0

    def outline(self, glyph: int) -> list[tuple]:
        """Moves, lines, curves and closings in units of the font; empty for glyphs without shape."""
        if glyph not in self.cache:
            try:
                self.cache[glyph] = self._outline(glyph, 0)
            except (struct.error, IndexError):
                self.cache[glyph] = []
        return self.cache[glyph]

    def _outline(self, glyph: int, depth: int) -> list[tuple]:
        begin, end = struct.unpack_from(">II", self.loca, 4 * glyph) if self.long else (2 * x for x in struct.unpack_from(">HH", self.loca, 2 * glyph))
        data = self.glyf[begin:end]
        if len(data) < 10:
            return []
        contours = struct.unpack_from(">h", data)[0]
        return self._simple(data, contours) if contours >= 0 else self._composite(data, depth)

    @staticmethod
    def _simple(data: bytes, contours: int) -> list[tuple]:
        ends = struct.unpack_from(f">{contours}H", data, 10)
        at = 10 + 2 * contours
        at += 2 + struct.unpack_from(">H", data, at)[0]
        n, flags = (ends[-1] + 1 if ends else 0), []
        while len(flags) < n:
            flag, at = data[at], at + 1
            repeat = 1
            if flag & 8:
                repeat, at = data[at] + 1, at + 1
            flags += [flag] * repeat
        places = []
        for short, same in ((2, 16), (4, 32)):
            value, axis = 0, []
            for flag in flags[:n]:
                if flag & short:
                    value += data[at] if flag & same else -data[at]
                    at += 1
                elif not flag & same:
                    value += struct.unpack_from(">h", data, at)[0]
                    at += 2
                axis.append(value)
            places.append(axis)
        out, first = [], 0
        for last in ends:
            points = [((places[0][k], places[1][k]), bool(flags[k] & 1)) for k in range(first, last + 1)]
            out += _contour(points)
            first = last + 1
        return out

    def _composite(self, data: bytes, depth: int) -> list[tuple]:
        out, at, more = [], 10, depth < MAX_PARTS
        while more:
            flags, glyph = struct.unpack_from(">HH", data, at)
            dx, dy = struct.unpack_from(">hh" if flags & 1 else ">bb", data, at + 4)
            at += 8 if flags & 1 else 6
            if not flags & 2:
                dx = dy = 0
            size = 1 if flags & 8 else 2 if flags & 0x40 else 4 if flags & 0x80 else 0
            given = [x / 16384 for x in struct.unpack_from(f">{size}h", data, at)]
            at += 2 * size
            a, b, c, d = {0: [1, 0, 0, 1], 1: [*given[:1], 0, 0, *given[:1]], 2: [*given[:1], 0, 0, *given[1:]], 4: given}[size]
            move = lambda p, a=a, b=b, c=c, d=d, dx=dx, dy=dy: (a * p[0] + c * p[1] + dx, b * p[0] + d * p[1] + dy)
            out += [(op, *map(move, places)) for op, *places in self._outline(glyph, depth + 1)]
            more = bool(flags & 0x20)
        return out


def _contour(points: list[tuple[Point, bool]]) -> list[tuple]:
    """A closed contour; between two control points a point on the curve is implied, and each curve becomes a cubic one."""
    if not points:
        return []
    half = lambda p, q: ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2)
    begin = next((k for k, (_, on) in enumerate(points) if on), None)
    if begin is None:
        points, begin = [(half(points[-1][0], points[0][0]), True), *points], 0
    points = points[begin:] + points[:begin]
    start = at = points[0][0]
    out: list[tuple] = [("m", start)]
    control = None

    def curve(c: Point, p: Point) -> tuple:
        third = lambda q: (q[0] + 2 * (c[0] - q[0]) / 3, q[1] + 2 * (c[1] - q[1]) / 3)
        return "c", third(at), third(p), p

    for p, on in [*points[1:], (start, True)]:
        if on:
            out.append(curve(control, p) if control else ("l", p))
            at, control = p, None
        else:
            if control:
                middle = half(control, p)
                out.append(curve(control, middle))
                at = middle
            control = p
    return [*out, ("h",)]
