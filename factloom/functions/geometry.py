"""Boxes as Column expressions over struct<x0,y0,x1,y1> (O-01..O-13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*[(c if isinstance(c, Column) else F.lit(c)).alias(n) for c, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"))])


def normalize(b: Column, width: Column, height: Column, scale: int = 1000) -> Column:
    """O-01: clamp to the page, swap inverted sides, scale, round half to even."""
    clamp = lambda v, most: F.greatest(F.lit(0.0), F.least(v.cast("double"), most.cast("double")))
    x = [clamp(b[c], width) for c in ("x0", "x1")]
    y = [clamp(b[c], height) for c in ("y0", "y1")]
    at = lambda v, most: F.bround(v / most * scale, 0).cast("int")
    return box(at(F.least(*x), width), at(F.least(*y), height), at(F.greatest(*x), width), at(F.greatest(*y), height))


def from_quad(quad: Column) -> Column:
    """O-02: bounding box of a polygon given as array<struct<x,y>>."""
    xs, ys = F.transform(quad, lambda p: p["x"]), F.transform(quad, lambda p: p["y"])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def from_coco(x: Column, y: Column, w: Column, h: Column) -> Column:
    """O-03: corner and size to corners."""
    return box(x, y, x + w, y + h)


def union(b: Column) -> Column:
    """O-04: aggregate: the box around all boxes of a group; no rows, or null boxes only: null."""
    return F.when(F.count(b["x0"]) > 0, box(F.min(b["x0"]), F.min(b["y0"]), F.max(b["x1"]), F.max(b["y1"])))


def area(b: Column) -> Column:
    """O-05: never negative."""
    return F.greatest(F.lit(0), b["x1"] - b["x0"]) * F.greatest(F.lit(0), b["y1"] - b["y0"])


def expand(b: Column, dx, dy, width: Column, height: Column) -> Column:
    """O-06: wider on all sides, within the page."""
    return box(F.greatest(F.lit(0), b["x0"] - dx), F.greatest(F.lit(0), b["y0"] - dy), F.least(width, b["x1"] + dx), F.least(height, b["y1"] + dy))


def denormalize(b: Column, width: Column, height: Column, scale: int = 1000) -> Column:
    """O-07: back to pixels, truncated."""
    at = lambda v, most: (v * most / scale).cast("int")
    return box(at(b["x0"], width), at(b["y0"], height), at(b["x1"], width), at(b["y1"], height))


def center_in(inner: Column, outer: Column) -> Column:
    """O-08: the centre of one box lies in another, edges included."""
    cx, cy = (inner["x0"] + inner["x1"]) / 2, (inner["y0"] + inner["y1"]) / 2
    return cx.between(outer["x0"], outer["x1"]) & cy.between(outer["y0"], outer["y1"])


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """O-09: common length of two intervals."""
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """O-09: distance between two intervals."""
    return F.greatest(F.lit(0), F.greatest(a0, b0) - F.least(a1, b1))


def overlap_ratio(a: Column, b: Column) -> Column:
    """O-10: common area by the smaller area."""
    common = overlap(a["x0"], a["x1"], b["x0"], b["x1"]) * overlap(a["y0"], a["y1"], b["y0"], b["y1"])
    return F.coalesce(F.try_divide(common, F.least(area(a), area(b))), F.lit(0.0))


def translate(b: Column, x: Column, y: Column) -> Column:
    """O-11: into the frame of a crop whose corner is (x, y)."""
    return box(b["x0"] - x, b["y0"] - y, b["x1"] - x, b["y1"] - y)


def valid(b: Column, scale: int = 1000) -> Column:
    """O-12: four values within 0..scale, in order."""
    inside = [F.coalesce(b[c].between(0, scale), F.lit(False)) for c in ("x0", "y0", "x1", "y1")]
    return inside[0] & inside[1] & inside[2] & inside[3] & F.coalesce((b["x0"] <= b["x1"]) & (b["y0"] <= b["y1"]), F.lit(False))


def out_of_bounds(b: Column, width: Column, height: Column) -> Column:
    """O-13: clamping would change the box."""
    return F.coalesce((b["x0"] < 0) | (b["y0"] < 0) | (b["x1"] > width) | (b["y1"] > height), F.lit(False))


def upper_median(values: Column) -> Column:
    """The element in the middle of a collected array, the upper one of two."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))
