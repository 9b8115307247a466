"""Content streams to display items: a fold over instructions with a graphics state."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from typing import Any

import numpy as np

from quire.sources.pdf.cos import Name, PdfError, Ref, Stream, instructions
from quire.sources.pdf.document import Document, Page
from quire.sources.pdf.filters import decode
from quire.sources.pdf.fonts import Font

Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
MAX_FORMS = 12
_ZEROS = [0.0] * 6
PAINT = {"S": "s", "s": "s", "f": "f", "F": "f", "f*": "f", "B": "fs", "B*": "fs", "b": "fs", "b*": "fs", "n": ""}


def then(m: Matrix, n: Matrix) -> Matrix:
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


@dataclass(frozen=True)
class State:
    ctm: Matrix = IDENTITY
    font: Font | None = None
    size: float = 0.0
    char: float = 0.0
    word: float = 0.0
    scale: float = 1.0
    leading: float = 0.0
    rise: float = 0.0
    width: float = 1.0
    fill: tuple[float, ...] = (0.0,)
    stroke: tuple[float, ...] = (0.0,)
    fill_alpha: float = 1.0
    stroke_alpha: float = 1.0
    clips: int = 0
    clip: tuple = ()


def replace(state: State, **changes: Any) -> State:
    """A copy with some fields changed; dataclasses.replace() sets every field by itself."""
    out = object.__new__(State)
    out.__dict__.update(state.__dict__, **changes)
    return out


def origins(run: dict[str, Any]) -> tuple[np.ndarray, np.ndarray]:
    """Where each glyph of a run stands."""
    size, char, word, scale = run["pace"]
    steps = np.array(run["widths"]) / 1000 * size + char
    if word:
        steps += word * (np.array(run["codes"]) == 32)
    gone = np.concatenate(([0.0], np.cumsum(steps[:-1]))) * scale
    return run["m"][4] + gone * run["along"][0], run["m"][5] + gone * run["along"][1]


def glyphs(run: dict[str, Any]) -> list[dict[str, Any]]:
    """A run as single glyphs."""
    same = {"kind": "glyph", "annot": run["annot"], "font": run["font"], "estimated": run["estimated"]}
    shape = run["m"][:4]
    return [same | {"code": c, "uni": u, "m": (*shape, x, y)} for c, u, x, y in zip(run["codes"], run["texts"], *(o.tolist() for o in origins(run)), strict=True)]


def text_of(items: list[dict[str, Any]]) -> str:
    """The text of a page's runs: a line break where glyphs stand more than half the taller height apart."""
    out: list[str] = []
    last, above = None, 1.0
    for run in items:
        if run["kind"] != "run":
            continue
        height = max(abs(run["m"][3]), 1.0)
        if run["along"][1] == 0 or len(run["codes"]) == 1:
            text = "".join(filter(None, run["texts"])) if None in run["texts"] else "".join(run["texts"])
            pieces = [(text, run["m"][5])] if text or any(x is not None for x in run["texts"]) else []
        else:
            pieces = [(x, y) for x, y in zip(run["texts"], origins(run)[1].tolist(), strict=True) if x is not None]
        for text, y in pieces:
            if last is not None and abs(y - last) > 0.5 * max(height, above):
                out.append("\n")
            out.append(text)
            last, above = y, height
    return "".join(out)


class Interpreter:
    """Runs pages of one document; fonts are loaded once a document."""

    def __init__(self, doc: Document):
        self.doc, self.fonts = doc, {}

    def page(self, page: Page, annotations: bool = False) -> list[dict[str, Any]]:
        """Display items in order, a glyph each."""
        out: list[dict[str, Any]] = []
        for item in self.runs(page, annotations):
            out += glyphs(item) if item["kind"] == "run" else [item]
        return out

    def runs(self, page: Page, annotations: bool = False) -> list[dict[str, Any]]:
        """Display items in order; glyphs that one string shows stay together as a run."""
        self.items, self.ignored = [], Counter()
        self._run(self.doc.content(page), page.resources, State(), 0, False)
        if annotations:
            for annot in map(self.doc.get, self.doc.get(page.dict.get("Annots")) or []):
                try:
                    self._appearance(annot)
                except (PdfError, TypeError, ValueError, ZeroDivisionError):
                    continue
        return self.items

    def _appearance(self, annot: Any) -> None:
        """A visible annotation's normal appearance, its box fitted to the rectangle."""
        doc = self.doc
        if not isinstance(annot, dict) or (doc.get(annot.get("F")) or 0) & 0x22:
            return
        form = doc.find(annot, "AP", "N")
        if isinstance(form, dict):
            form = doc.get(form.get(str(annot.get("AS"))))
        rect = [float(doc.get(x)) for x in doc.get(annot.get("Rect")) or []]
        if not isinstance(form, Stream) or len(rect) != 4:
            return
        box = [float(doc.get(x)) for x in doc.get(form.dict.get("BBox")) or []] or [0.0, 0.0, 1.0, 1.0]
        m = tuple(float(doc.get(x)) for x in doc.get(form.dict.get("Matrix")) or IDENTITY)
        corners = [(x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]) for x in box[::2] for y in box[1::2]]
        x0, y0 = (min(c[k] for c in corners) for k in (0, 1))
        x1, y1 = (max(c[k] for c in corners) for k in (0, 1))
        left, low = min(rect[0], rect[2]), min(rect[1], rect[3])
        sx = abs(rect[2] - rect[0]) / (x1 - x0) if x1 > x0 else 1.0
        sy = abs(rect[3] - rect[1]) / (y1 - y0) if y1 > y0 else 1.0
        fit = (sx, 0.0, 0.0, sy, left - x0 * sx, low - y0 * sy)
        self._run(decode(form, doc.get), doc.get(form.dict.get("Resources")) or {}, State(ctm=then(m, fit)), 1, True)

    def _run(self, data: bytes, resources: dict[str, Any], state: State, depth: int, annot: bool) -> None:
        doc, stack = self.doc, []
        tm = line = IDENTITY
        path: list[tuple[float, float]] = []
        segments: list[tuple] = []
        start, clipping = (0.0, 0.0), ""

        def show(raw: Any) -> None:
            nonlocal tm
            if not isinstance(raw, bytes):
                return
            font = state.font
            codes, texts, widths = font.shown(raw) if font else (list(raw), [None] * len(raw), [500.0] * len(raw))
            if not codes:
                return
            shape = (state.size * state.scale, 0.0, 0.0, state.size, 0.0, state.rise)
            along = tm[0] * state.ctm[0] + tm[1] * state.ctm[2], tm[0] * state.ctm[1] + tm[1] * state.ctm[3]
            spaced = state.word if font and not font.composite else 0.0
            self.items.append({"kind": "run", "annot": annot, "font": font.base if font else None, "codes": codes, "texts": texts, "widths": widths, "m": then(then(shape, tm), state.ctm), "along": along, "pace": (state.size, state.char, spaced, state.scale), "estimated": font is None, "face": font, "fill": state.fill, "alpha": state.fill_alpha, "clip": state.clip})
            step = (sum(widths) / 1000 * state.size + len(codes) * state.char + (codes.count(32) * spaced if spaced else 0.0)) * state.scale
            tm = then((1.0, 0.0, 0.0, 1.0, step, 0.0), tm)

        def point(x: float, y: float) -> tuple[float, float]:
            m = state.ctm
            return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]

        for op, operands in instructions(data):
            v = [float(x) if type(x) is float or type(x) is int else 0.0 for x in operands] + _ZEROS
            if op == "q":
                stack.append(state)
            elif op == "Q":
                state = stack.pop() if stack else state
            elif op == "cm":
                state = replace(state, ctm=then(tuple(v[:6]), state.ctm))
            elif op in ("m", "l", "c", "v", "y", "re", "h"):
                if op == "re":
                    x, y, w, h = v[:4]
                    corners = [point(*p) for p in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
                    segments += [("m", corners[0]), *(("l", p) for p in corners[1:]), ("h",)]
                    path += corners
                elif op == "h":
                    path.append(start)
                    segments.append(("h",))
                else:
                    n = {"m": 1, "l": 1, "c": 3, "v": 2, "y": 2}[op]
                    places = [point(*v[2 * k : 2 * k + 2]) for k in range(n)]
                    segments.append((op, *places) if n != 2 else ("c", path[-1] if path else places[0], *places) if op == "v" else ("c", *places, places[-1]))
                    path += places
                    start = path[-1] if op == "m" else start
            elif op in ("W", "W*"):
                clipping = op
            elif op in PAINT:
                if path and (PAINT[op] or clipping):
                    xs, ys = zip(*path, strict=True)
                    self.items.append({"kind": "path", "annot": annot, "paint": PAINT[op], "rule": "evenodd" if op.endswith("*") else "nonzero", "box": [min(xs), min(ys), max(xs), max(ys)], "points": len(path), "fill": list(state.fill), "stroke": list(state.stroke), "clips": state.clips, "segments": segments, "alphas": (state.fill_alpha, state.stroke_alpha), "width": state.width, "clip": state.clip})
                if clipping and path:
                    state = replace(state, clips=state.clips + 1, clip=(*state.clip, (segments, "evenodd" if clipping == "W*" else "nonzero")))
                path, segments, clipping = [], [], ""
            elif op in ("g", "rg", "k", "sc", "scn", "G", "RG", "K", "SC", "SCN"):
                color = tuple(float(x) for x in operands if isinstance(x, int | float))
                if len(color) in (1, 3, 4):
                    state = replace(state, **{"fill" if op.islower() else "stroke": color})
            elif op == "w":
                state = replace(state, width=v[0])
            elif op == "gs":
                g = doc.find(resources, "ExtGState", str(operands[0]) if operands else "") or {}
                for key, field in (("LW", "width"), ("ca", "fill_alpha"), ("CA", "stroke_alpha")):
                    x = doc.get(g.get(key))
                    if isinstance(x, int | float):
                        state = replace(state, **{field: float(x) if key == "LW" else min(max(float(x), 0.0), 1.0)})
            elif op == "BT":
                tm = line = IDENTITY
            elif op == "Tf":
                fonts = doc.find(resources, "Font") or {}
                state = replace(state, font=self._font(fonts.get(str(operands[0])) if operands else None), size=v[1])
            elif op in ("Tc", "Tw", "TL", "Ts"):
                state = replace(state, **{{"Tc": "char", "Tw": "word", "TL": "leading", "Ts": "rise"}[op]: v[0]})
            elif op == "Tz":
                state = replace(state, scale=v[0] / 100)
            elif op == "Tm":
                tm = line = tuple(v[:6])
            elif op in ("Td", "TD", "T*"):
                if op == "TD":
                    state = replace(state, leading=-v[1])
                x, y = (0.0, -state.leading) if op == "T*" else v[:2]
                tm = line = then((1.0, 0.0, 0.0, 1.0, x, y), line)
            elif op == "Tj":
                show(operands[0] if operands else b"")
            elif op in ("'", '"'):
                if op == '"':
                    state = replace(state, word=v[0], char=v[1])
                tm = line = then((1.0, 0.0, 0.0, 1.0, 0.0, -state.leading), line)
                show(operands[-1] if operands else b"")
            elif op == "TJ":
                for x in operands[0] if operands and isinstance(operands[0], list) else []:
                    if isinstance(x, bytes):
                        show(x)
                    elif isinstance(x, int | float):
                        tm = then((1.0, 0.0, 0.0, 1.0, -x / 1000 * state.size * state.scale, 0.0), tm)
            elif op == "Do":
                x = doc.find(resources, "XObject", str(operands[0]) if operands else "")
                if isinstance(x, Stream) and x.dict.get("Subtype") == "Image":
                    m = state.ctm
                    self.items.append({"kind": "image", "annot": annot, "m": m, "stream": x, "clip": state.clip, "width": doc.get(x.dict.get("Width")), "height": doc.get(x.dict.get("Height"))})
                elif isinstance(x, Stream) and depth < MAX_FORMS:
                    m = tuple(float(doc.get(y)) for y in doc.get(x.dict.get("Matrix")) or IDENTITY)
                    try:
                        self._run(decode(x, doc.get), doc.get(x.dict.get("Resources")) or resources, replace(state, ctm=then(m, state.ctm)), depth + 1, annot)
                    except PdfError:
                        self.ignored["Do"] += 1
            elif op != "ET":
                self.ignored[op] += 1

    def _font(self, value: Any) -> Font | None:
        key = value.num if isinstance(value, Ref) else id(value)
        if key not in self.fonts:
            try:
                self.fonts[key] = Font(self.doc, value) if value is not None else None
            except (PdfError, TypeError, KeyError, ValueError):
                self.fonts[key] = None
        return self.fonts[key]


__all__ = ["Interpreter", "Name"]
