"""Boxes: structs of x1, y1, x2, y2 in page pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliary.schemas import box


def from_points(points: Column) -> Column:
    """A box from four numbers as [[x1, y1, x2, y2]], or from a polygon of [x, y] points; rounded half to even; else zeros."""
    four = (F.size(points) == 1) & (F.size(points[0]) == 4)
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    r = lambda c: F.bround(c)
    zero = F.lit(0)
    return (
        F.when(four, box(r(points[0][0]), r(points[0][1]), r(F.get(points[0], F.lit(2))), r(F.get(points[0], F.lit(3)))))
        .when(F.size(points) > 1, box(r(F.array_min(xs)), r(F.array_min(ys)), r(F.array_max(xs)), r(F.array_max(ys))))
        .otherwise(box(zero, zero, zero, zero))
    )


def clamp(b: Column, width: Column, height: Column) -> Column:
    """The box within the page, at least one pixel wide and high."""
    x1 = F.greatest(F.lit(0), F.least(width - 1, b["x1"]))
    y1 = F.greatest(F.lit(0), F.least(height - 1, b["y1"]))
    x2 = F.greatest(F.lit(0), F.least(width, b["x2"]))
    y2 = F.greatest(F.lit(0), F.least(height, b["y2"]))
    return box(x1, y1, F.when(x2 <= x1, F.least(width, x1 + 1)).otherwise(x2), F.when(y2 <= y1, F.least(height, y1 + 1)).otherwise(y2))


def crop_box(b: Column, by: Column, width: Column, height: Column) -> Column:
    """The part of a page image that a model sees of a box: widened by a margin, within the page."""
    return clamp(box(b["x1"] - by, b["y1"] - by, b["x2"] + by, b["y2"] + by), width, height)


def area(b: Column) -> Column:
    return F.greatest(F.lit(0), b["x2"] - b["x1"]) * F.greatest(F.lit(0), b["y2"] - b["y1"])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.when((w <= 0) | (h <= 0), F.lit(0)).otherwise(w * h)


def horizontal_overlap(a: Column, b: Column) -> Column:
    """Common width as a share of the narrower box."""
    common = F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    return common / F.greatest(F.lit(1), F.least(a["x2"] - a["x1"], b["x2"] - b["x1"]))


def vertical_gap(a: Column, b: Column) -> Column:
    return F.when(b["y1"] >= a["y2"], b["y1"] - a["y2"]).when(a["y1"] >= b["y2"], a["y1"] - b["y2"]).otherwise(F.lit(0))


def center_inside(a: Column, b: Column) -> Column:
    return ((a["x1"] + a["x2"]) / 2).between(b["x1"], b["x2"]) & ((a["y1"] + a["y2"]) / 2).between(b["y1"], b["y2"])


def union(a: Column, b: Column) -> Column:
    return box(F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]), F.greatest(a["x2"], b["x2"]), F.greatest(a["y2"], b["y2"]))
