"""Arithmetic of pages, colours and rectangles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_matrix(m: dict[str, Column], x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a matrix in row-vector form."""
    return m["a"] * x + m["c"] * y + m["e"], m["b"] * x + m["d"] * y + m["f"]


def then(m: dict[str, Column], n: dict[str, Column]) -> dict[str, Column]:
    """The matrix that applies m, then n."""
    out = {}
    for row, (p, q) in {"ab": ("a", "b"), "cd": ("c", "d")}.items():
        out[row[0]], out[row[1]] = m[p] * n["a"] + m[q] * n["c"], m[p] * n["b"] + m[q] * n["d"]
    out["e"], out["f"] = apply_matrix(n, m["e"], m["f"])
    return out


def rotate(current: Column, delta: Column) -> Column:
    return F.pmod(current + delta, F.lit(360))


def quarter(degrees: Column) -> Column:
    """The nearest of 0, 90, 180 and 270 degrees."""
    r = F.pmod(degrees, F.lit(360))
    return F.when((r >= 315) | (r < 45), 0).when(r < 135, 90).when(r < 225, 180).otherwise(270)


def pixel_size(width: Column, height: Column, degrees: Column, scale: Column) -> tuple[Column, Column]:
    """Size in pixels, at least 1; quarter turns to the side swap it; scales are at least 0.01."""
    s = F.greatest(scale, F.lit(0.01))
    turned = quarter(degrees).isin(90, 270)
    w, h = F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)
    return F.greatest(F.round(w * s), F.lit(1.0)).cast("int"), F.greatest(F.round(h * s), F.lit(1.0)).cast("int")


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> list[Column]:
    return [F.round(255 * (1 - x) * (1 - k)).cast("int") for x in (c, m, y)]


def moved(place: Column, origin: Column, target: Column) -> Column:
    """Where a page lands when the page at `origin` is taken out and put in at `target`."""
    forward = (origin < target) & place.between(origin + 1, target)
    back = (target < origin) & place.between(target, origin - 1)
    return F.when(place == origin, target).when(forward, place - 1).when(back, place + 1).otherwise(place)


def rescale(value: Column, old: tuple[Column, Column], new: tuple[Column, Column]) -> Column:
    """A coordinate carried along when its rectangle's sides move; degenerate rectangles shift."""
    width = old[1] - old[0]
    return F.when(F.abs(width) > 1e-9, new[0] + (value - old[0]) * (new[1] - new[0]) / width).otherwise(value + new[0] - old[0])


def to_screen(x: Column, y: Column, left: Column, top: Column, scale: Column) -> tuple[Column, Column]:
    """Page point to screen point: y turns about the top of the media box."""
    return (x - left) * scale, (top - y) * scale


def to_page(x: Column, y: Column, left: Column, top: Column, scale: Column) -> tuple[Column, Column]:
    return left + x / scale, top - y / scale


def fit_scale(available_w: Column, available_h: Column, width: Column, height: Column, low: float = 0.1, high: float = 10.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), (available_w - 4) / width, (available_h - 4) / height))


def resized(x0: Column, y0: Column, x1: Column, y1: Column, dx: Column, dy: Column, least: float = 4.0) -> list[Column]:
    """A rectangle whose upper right corner is dragged, never smaller than `least`."""
    return [x0, y0, F.greatest(x0 + least, x1 + dx), F.greatest(y0 + least, y1 + dy)]


def go_to(text: Column, pages: Column) -> Column:
    """Page index from what a reader types, counted from 1; null unless it names a page."""
    at = F.try_to_number(F.btrim(text), F.lit("999999999")).cast("int") - 1
    return F.when((at >= 0) & (at < pages), at)


def bounding(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the box around all boxes (x0, y0, x1, y1) of each; rows without a box do not count."""
    return rows.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def device_matrix(width: Column, height: Column, degrees: Column, scale: Column) -> dict[str, Column]:
    """Page points to pixels, top row first: y is turned about the page's top, the page by quarter turns, then scaled."""
    turn, zero = quarter(degrees), F.lit(0.0)
    pick = lambda a, b, c, d: F.when(turn == 90, b).when(turn == 180, c).when(turn == 270, d).otherwise(a)
    return {"a": pick(scale, zero, -scale, zero), "b": pick(zero, scale, zero, -scale), "c": pick(zero, scale, zero, -scale), "d": pick(-scale, zero, scale, zero), "e": pick(zero, zero, scale * width, scale * height), "f": pick(scale * height, zero, zero, scale * width)}
