"""Pages as pixels: filled and stroked paths, clips, images and the glyphs of embedded TrueType fonts over white.

Shapes become edges; where edges cross the lines of a grid four times as fine as the pixels, winding numbers change, and
their running sums along a line say what is inside. A pixel's coverage is the share of its sixteen samples inside.
Text in other fonts is left out.
"""

from __future__ import annotations

import math
from typing import Any

import numpy as np

from quire.sources.pdf import images
from quire.sources.pdf.cos import PdfError
from quire.sources.pdf.document import Document, Page
from quire.sources.pdf.interpret import Interpreter, Matrix, origins, then

FINE, CURVE = 4, 16
MITER, LEAST_WIDTH, LEAST_SCALE = 4.0, 0.1, 0.01
MAX_PIXELS = 1 << 26


def quarter(degrees: int) -> int:
    """The nearest of 0, 90, 180 and 270 degrees."""
    return (degrees + 45) % 360 // 90 * 90


def device(page: Page, scale: float, turn: int) -> tuple[int, int, Matrix]:
    """Width and height in pixels and the matrix from page points to them, top row first."""
    x0, y0, x1, y1 = page.media_box
    left, top, wide, high = min(x0, x1), max(y0, y1), abs(x1 - x0) * scale, abs(y1 - y0) * scale
    flip = (scale, 0.0, 0.0, -scale, -left * scale, top * scale)
    rest = {0: (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), 90: (0.0, 1.0, -1.0, 0.0, high, 0.0), 180: (-1.0, 0.0, 0.0, -1.0, wide, high), 270: (0.0, -1.0, 1.0, 0.0, 0.0, wide)}[turn]
    if turn in (90, 270):
        wide, high = high, wide
    return max(1, int(wide + 0.5)), max(1, int(high + 0.5)), then(flip, rest)


def polygons(segments: list[tuple], matrix: Matrix) -> list[tuple[np.ndarray, bool]]:
    """Points of each part of a path, curves as short lines, and whether it was closed."""
    parts: list[tuple[list, bool]] = []
    points: list[tuple[float, float]] = []
    t = np.linspace(0, 1, CURVE + 1)[1:, None]

    def close(done: bool) -> None:
        nonlocal points
        if points:
            parts.append((points, done))
        points = [points[0]] if done and points else []

    for op, *rest in segments:
        if op == "m":
            close(False)
            points = [rest[0]]
        elif op == "l":
            points.append(rest[0])
        elif op == "c" and points:
            a, b, c, d = (np.array(p) for p in (points[-1], *rest))
            points += map(tuple, (1 - t) ** 3 * a + 3 * t * (1 - t) ** 2 * b + 3 * t**2 * (1 - t) * c + t**3 * d)
        elif op == "h":
            close(True)
    close(False)
    m = np.array(matrix).reshape(3, 2)
    return [(np.array(p) @ m[:2] + m[2], done) for p, done in parts if len(p) > 1 or done]


def stroked(parts: list[tuple[np.ndarray, bool]], width: float) -> list[np.ndarray]:
    """Outlines whose union a pen of that width covers: a box a line and a wedge a corner, all turning the same way."""
    out: list[np.ndarray] = []
    half = width / 2

    def add(points: np.ndarray) -> None:
        (x, y), (u, v) = points.T, np.concatenate((points[1:], points[:1])).T
        out.append(points if np.dot(x, v) >= np.dot(y, u) else points[::-1])

    for points, closed in parts:
        points = np.concatenate((points, points[:1])) if closed else points
        along = np.diff(points, axis=0)
        size = np.hypot(*along.T)
        points, along = np.concatenate((points[:-1][size > 1e-9], points[-1:])), along[size > 1e-9] / size[size > 1e-9, None]
        normal = np.stack((-along[:, 1], along[:, 0]), axis=1) * half
        for k in range(len(along)):
            add(np.array([points[k] + normal[k], points[k + 1] + normal[k], points[k + 1] - normal[k], points[k] - normal[k]]))
        for k in range(0 if closed else 1, len(along)):
            a, b, p = along[k - 1], along[k], points[k]
            side = -np.sign(a[0] * b[1] - a[1] * b[0])
            if side == 0:
                continue
            n, m = normal[k - 1] * side, normal[k] * side
            opening = 1 + float(a @ b)
            tip = [p + (n + m) / opening] if opening > 1e-6 and 2 / opening <= MITER**2 else []
            add(np.array([p, p + n, *tip, p + m]))
    return out


def _upright(outline: np.ndarray) -> tuple[float, float, float, float] | None:
    """Left, top, right and lower side of a box whose sides are exactly upright and level, else none."""
    if len(outline) != 4:
        return None
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = outline.tolist()
    if ax == bx and by == cy and cx == dx and dy == ay or ay == by and bx == cx and cy == dy and dx == ax:
        return min(ax, cx), min(ay, cy), max(ax, cx), max(ay, cy)
    return None


def _box_coverage(x0: float, y0: float, x1: float, y1: float, width: int, height: int) -> tuple[slice, slice, np.ndarray] | None:
    """coverage() of a box: the samples inside are those of some lines in some columns."""

    def share(low: float, high: float, first: int, n: int) -> np.ndarray:
        begin, end = (min(max(math.ceil((v - first) * FINE - 0.5), 0), n * FINE) for v in (low, high))
        at = np.arange(n) * FINE
        return (np.minimum(at + FINE, end) - np.maximum(at, begin)).clip(0, FINE) / FINE

    left, top = (min(max(math.floor(v), 0), 1 << 30) for v in (x0, y0))
    right, low = min(width, math.ceil(x1)), min(height, math.ceil(y1))
    if right <= left or low <= top:
        return None
    return slice(top, low), slice(left, right), np.outer(share(y0, y1, top, low - top), share(x0, x1, left, right - left))


def coverage(outlines: list[np.ndarray], even_odd: bool, width: int, height: int) -> tuple[slice, slice, np.ndarray] | None:
    """Rows, columns and the share of each pixel there that lies inside the outlines; none if they lie outside the page."""
    if not outlines:
        return None
    if len(outlines) == 1 and (box := _upright(outlines[0])):
        return _box_coverage(*box, width, height)
    a = np.concatenate(outlines)
    b = np.concatenate([q for p in outlines for q in (p[1:], p[:1])])
    left, top = (max(0, int(np.floor(v))) for v in a.min(axis=0).clip(0, 1 << 30))
    right, low = min(width, int(np.ceil(a[:, 0].max()))), min(height, int(np.ceil(a[:, 1].max())))
    if right <= left or low <= top:
        return None
    a, b = (a - (left, top)) * FINE, (b - (left, top)) * FINE
    rows, columns = (low - top) * FINE, (right - left) * FINE
    up = a[:, 1] > b[:, 1]
    first, last = np.where(up[:, None], b, a), np.where(up[:, None], a, b)
    begin, end = (np.ceil(v[:, 1] - 0.5).clip(0, rows).astype(int) for v in (first, last))
    count = np.maximum(end - begin, 0)
    edge = np.repeat(np.arange(len(a)), count)
    row = np.arange(len(edge)) - np.repeat(np.cumsum(count) - count, count) + begin[edge]
    slope = (last[:, 0] - first[:, 0]) / np.where(last[:, 1] > first[:, 1], last[:, 1] - first[:, 1], 1.0)
    column = np.ceil(first[edge, 0] + (row + 0.5 - first[edge, 1]) * slope[edge] - 0.5).clip(0, columns).astype(int)
    change = np.bincount(row * (columns + 1) + column, np.where(up, -1.0, 1.0)[edge], rows * (columns + 1)).astype(np.int32).reshape(rows, columns + 1)
    winding = np.cumsum(change, axis=1)[:, :columns]
    inside = winding % 2 != 0 if even_odd else winding != 0
    return slice(top, low), slice(left, right), inside.reshape(low - top, FINE, right - left, FINE).mean(axis=(1, 3))


def rgb(color: list[float] | tuple[float, ...]) -> np.ndarray:
    c = np.clip(np.array(color, float), 0, 1)
    return np.repeat(c, 3) * 255 if len(c) == 1 else c * 255 if len(c) == 3 else np.floor(255 * (1 - c[:3]) * (1 - c[3]) + 0.5)


class Canvas:
    """Opaque pixels that items are painted on."""

    def __init__(self, width: int, height: int, matrix: Matrix, scale: float):
        self.pixels, self.matrix, self.scale = np.full((height, width, 3), 255.0), matrix, scale
        self.masks: dict[int, np.ndarray] = {}

    def mask(self, clip: tuple) -> np.ndarray | None:
        """The product of all clips' coverages; items that share their clips share the mask."""
        if not clip:
            return None
        if id(clip) not in self.masks:
            height, width = self.pixels.shape[:2]
            whole = np.ones((height, width))
            for segments, rule in clip:
                own = np.zeros((height, width))
                if found := coverage([p for p, _ in polygons(segments, self.matrix)], rule == "evenodd", width, height):
                    own[found[0], found[1]] = found[2]
                whole *= own
            self.masks = {id(clip): whole}
        return self.masks[id(clip)]

    def paint(self, found: tuple[slice, slice, np.ndarray] | None, color: np.ndarray, alpha: float, clip: tuple) -> None:
        if found is None:
            return
        rows, columns, share = found
        mask = self.mask(clip)
        share = (share if mask is None else share * mask[rows, columns])[..., None] * alpha
        self.pixels[rows, columns] += (color - self.pixels[rows, columns]) * share

    def path(self, item: dict[str, Any]) -> None:
        height, width = self.pixels.shape[:2]
        parts = polygons(item["segments"], self.matrix)
        if "f" in item["paint"]:
            self.paint(coverage([p for p, _ in parts], item["rule"] == "evenodd", width, height), rgb(item["fill"]), item["alphas"][0], item["clip"])
        if "s" in item["paint"]:
            self.paint(coverage(stroked(parts, max(item["width"], LEAST_WIDTH) * self.scale), False, width, height), rgb(item["stroke"]), item["alphas"][1], item["clip"])

    def run(self, item: dict[str, Any]) -> None:
        """The glyphs of a string, where its font brings their outlines."""
        face = item["face"].face() if item["face"] is not None else None
        if face is None:
            return
        height, width = self.pixels.shape[:2]
        color = rgb(item["fill"])
        for code, text, x, y in zip(item["codes"], item["texts"], *(o.tolist() for o in origins(item)), strict=True):
            if segments := item["face"].outline(code, text):
                matrix = then(tuple(v / face.units for v in item["m"][:4]) + (x, y), self.matrix)
                self.paint(coverage([p for p, _ in polygons(segments, matrix)], False, width, height), color, item["alpha"], item["clip"])

    def image(self, pixels: np.ndarray, matrix: Matrix, clip: tuple) -> None:
        """An image over the unit square of its matrix, each pixel from the nearest sample, by its own alpha."""
        a, b, c, d, e, f = then(matrix, self.matrix)
        if abs(a * d - b * c) < 1e-12:
            return
        height, width = self.pixels.shape[:2]
        corners = np.array([(x * a + y * c + e, x * b + y * d + f) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))])
        found = coverage([corners], False, width, height)
        if found is None:
            return
        rows, columns, share = found
        y, x = np.mgrid[rows, columns] + 0.5
        u, v = ((x - e) * d - (y - f) * c) / (a * d - b * c), ((y - f) * a - (x - e) * b) / (a * d - b * c)
        at = np.floor((1 - v) * pixels.shape[0]).astype(int).clip(0, pixels.shape[0] - 1), np.floor(u * pixels.shape[1]).astype(int).clip(0, pixels.shape[1] - 1)
        shown = pixels[at].astype(float)
        self.paint((rows, columns, share * shown[..., 3] / 255), shown[..., :3], 1.0, clip)


def render(doc: Document, page: Page, scale: float = 1.0, turn: int = 0) -> np.ndarray:
    """(height, width, 4) pixels of a page, turned by its own and the given degrees; images that cannot be read are left out."""
    scale = max(scale, LEAST_SCALE)
    width, height, matrix = device(page, scale, quarter(page.rotate + turn))
    if width * height > MAX_PIXELS:
        raise PdfError("TooLarge", f"{width} x {height} pixels")
    canvas = Canvas(width, height, matrix, scale)
    for item in Interpreter(doc).runs(page, True):
        if item["kind"] == "path" and item["paint"]:
            canvas.path(item)
        elif item["kind"] == "run":
            canvas.run(item)
        elif item["kind"] == "image":
            try:
                canvas.image(images.rgba(doc, item["stream"]), item["m"], item["clip"])
            except PdfError:
                continue
    out = np.full((height, width, 4), 255, np.uint8)
    out[..., :3] = canvas.pixels.clip(0, 255) + 0.5  # cut off, as all are above 0
    return out
