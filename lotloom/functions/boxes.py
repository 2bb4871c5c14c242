"""Box geometry, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def intersection(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Area common to two boxes."""
    width = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    height = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    return F.greatest(width, F.lit(0)) * F.greatest(height, F.lit(0))


def centre_inside(x: Column, y: Column, w: Column, h: Column, zx: Column, zy: Column, zw: Column, zh: Column) -> Column:
    cx, cy = x + w / 2, y + h / 2
    return cx.between(zx, zx + zw) & cy.between(zy, zy + zh)


def from_corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Corners in any order as struct(x, y, width, height); null for boxes without area."""
    whole = lambda c: F.bround(c).cast("int")
    w, h = whole(F.abs(x2 - x1)), whole(F.abs(y2 - y1))
    box = F.struct(whole(F.least(x1, x2)).alias("x"), whole(F.least(y1, y2)).alias("y"), w.alias("width"), h.alias("height"))
    return F.when((w > 0) & (h > 0), box)


def from_polygon(points: Column) -> Column:
    """Bounding box of array<struct<x, y>> (F25): corners are rounded before they are subtracted."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    x, y, r, b = (F.bround(f(c)).cast("int") for f, c in ((F.array_min, xs), (F.array_min, ys), (F.array_max, xs), (F.array_max, ys)))
    return F.when((r > x) & (b > y), F.struct(x.alias("x"), y.alias("y"), (r - x).alias("width"), (b - y).alias("height")))


def confidence(c: Column) -> Column:
    """Shares of 1; what is above 1 is taken as percent."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(c > 1, c / 100.0).otherwise(c)))


def word_ok(text: Column, conf: Column, width: Column, height: Column) -> Column:
    """Words of an OCR table that count (P12): a text, a number that is not negative, an area."""
    return (F.trim(text) != "") & F.coalesce(conf.try_cast("double") >= 0, F.lit(False)) & (width > 0) & (height > 0)


def scale_to(side: int, width: Column, height: Column) -> Column:
    """Factor that brings the longer side to `side` at most (F32)."""
    return F.least(F.lit(1.0), F.lit(float(side)) / F.greatest(width, height))


def scaled(v: Column, factor: Column, least: int = 0) -> Column:
    return F.greatest(F.bround(v * factor).cast("int"), F.lit(least))


def as_percent(v: Column, whole: Column) -> Column:
    """Position as a percentage of the image."""
    return F.when(whole > 0, v * 100.0 / whole).otherwise(F.lit(0.0))


def clamped(x: Column, size: Column, whole: Column, least: int) -> tuple[Column, Column]:
    """Position and size of a rectangle's side kept inside the image."""
    kept = F.least(F.greatest(size, F.lit(least)), whole)
    return F.least(F.greatest(x, F.lit(0)), whole - kept), kept


def inside(px: Column, py: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Point in box, borders included."""
    return px.between(x, x + w) & py.between(y, y + h)


def in_image(x: Column, y: Column, width: Column, height: Column) -> Column:
    """P16."""
    return (x >= 0) & (x < width) & (y >= 0) & (y < height)


def overflows(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Region that leaves its image."""
    return (x < 0) | (y < 0) | (x + w > width) | (y + h > height)
