"""Box arithmetic on ``x1, y1, x2, y2`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    """The four coordinate columns carrying a prefix or alias (``p.`` or ``gt_``)."""
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 for an empty union."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(0.0)


def containment(small: Box, large: Box) -> Column:
    """Share of the first box lying inside the second."""
    return F.when(area(small) > 0, intersection(small, large) / area(small)).otherwise(0.0)


def overlap(a: Box, b: Box, axis: str = "both") -> Column:
    """Overlap relative to the first box along x, y or by area."""
    if axis == "both":
        return containment(a, b)
    lo, hi = (0, 2) if axis == "x" else (1, 3)
    shared = F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo])
    length = a[hi] - a[lo]
    return F.when((shared > 0) & (length > 0), shared / length).otherwise(0.0)


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Box:
    return x, y, x + w, y + h


def from_centre(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def scaled(b: Box, width: Column, height: Column) -> Box:
    """Relative coordinates to pixels."""
    return b[0] * width, b[1] * height, b[2] * width, b[3] * height


def padded(b: Box, pad: float, width: Column, height: Column) -> Box:
    """Whole-pixel box grown by ``pad`` and clipped to the image."""
    whole = [c.cast("int") for c in b]
    return (
        F.greatest(F.lit(0), whole[0] - pad),
        F.greatest(F.lit(0), whole[1] - pad),
        F.least(width, whole[2] + pad),
        F.least(height, whole[3] + pad),
    )


def repaired(b: Box, width: Column, height: Column) -> Box:
    """Corners put in order, then clipped to the image."""
    return (
        F.greatest(F.lit(0.0), F.least(b[0], b[2])),
        F.greatest(F.lit(0.0), F.least(b[1], b[3])),
        F.least(width, F.greatest(b[0], b[2])),
        F.least(height, F.greatest(b[1], b[3])),
    )


def polygon_box(points: Column) -> Box:
    """Bounding box of ARRAY<STRUCT<x, y>>."""
    xs = F.transform(points, lambda p: p["x"])
    ys = F.transform(points, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def centre(lo: Column, hi: Column) -> Column:
    return (lo + hi) / 2
