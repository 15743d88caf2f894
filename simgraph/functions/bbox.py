"""Bounding boxes given as four columns x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def _clip(v: Column, top: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0)), top)


def _whole(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    box = F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    return F.when((x2 > x1) & (y2 > y1), box)


def clamp(box: Box, w: Column, h: Column) -> Column:
    """Cut to the frame; null where nothing is left."""
    x1, y1, x2, y2 = box
    return _whole(_clip(x1, w), _clip(y1, h), _clip(x2, w), _clip(y2, h))


def clamp_padded(box: Box, w: Column, h: Column, pad: float) -> Column:
    """Grow by a share of the box's size, cut, then drop fractions."""
    x1, y1, x2, y2 = box
    px, py = (x2 - x1) * pad, (y2 - y1) * pad
    cut = (_clip(x1 - px, w), _clip(y1 - py, h), _clip(x2 + px, w), _clip(y2 + py, h))
    return _whole(*(c.cast("int") for c in cut))


def clamp_int(box: Box, w: Column, h: Column) -> Column:
    """Drop fractions, then cut."""
    x1, y1, x2, y2 = (c.cast("int") for c in box)
    return _whole(_clip(x1, w), _clip(y1, h), _clip(x2, w), _clip(y2, h))


def offset(box: Box, ox: Column, oy: Column) -> Box:
    x1, y1, x2, y2 = box
    return x1 + ox, y1 + oy, x2 + ox, y2 + oy


def tlwh(box: Box) -> Box:
    x1, y1, x2, y2 = box
    return x1, y1, x2 - x1, y2 - y1


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 for boxes apart."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    inter = w * h
    area = lambda x: F.greatest(F.lit(0.0), x[2] - x[0]) * F.greatest(F.lit(0.0), x[3] - x[1])
    return F.when(inter <= 0, 0.0).otherwise(inter / F.greatest(area(a) + area(b) - inter, F.lit(1e-6)))
