"""Boxes: structs of x1, y1, x2, y2, in pixels of an image of width w and height h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadgrid import config as C


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def clamp(b: Column, w: Column, h: Column) -> Column:
    """Whole pixels, towards zero, then inside the image."""
    x1, y1, x2, y2 = (b[k].cast("int") for k in ("x1", "y1", "x2", "y2"))
    return box(F.greatest(x1, F.lit(0)), F.greatest(y1, F.lit(0)), F.least(x2, w), F.least(y2, h))


def has_area(b: Column) -> Column:
    return (b["x2"] > b["x1"]) & (b["y2"] > b["y1"])


def expand(b: Column, w: Column, h: Column, ratio: float = C.BOX_PADDING) -> Column:
    """Wider by a share of its sides on each side, inside the image."""
    dx = ((b["x2"] - b["x1"]) * F.lit(float(ratio))).cast("int")
    dy = ((b["y2"] - b["y1"]) * F.lit(float(ratio))).cast("int")
    return box(F.greatest(F.lit(0), b["x1"] - dx), F.greatest(F.lit(0), b["y1"] - dy), F.least(w, b["x2"] + dx), F.least(h, b["y2"] + dy))


def best_boxes(boxes: Column, w: Column, h: Column, ratio: float = C.BOX_PADDING) -> Column:
    """array<struct<conf, pos, box>>, of one at most: the box with the highest confidence that has area in the image, the first of equal ones.

    Empty without one. Boxes without a comparable confidence, or at most -1, count for nothing.
    The best is named by a lambda's variable, so that it is found once and not for each of its fields.
    """
    seen = F.transform(boxes, lambda b, i: F.struct(b["conf"].alias("conf"), (-i).alias("back"), clamp(b, w, h).alias("box")))
    valid = F.filter(seen, lambda b: has_area(b["box"]) & ~F.isnan(b["conf"]) & (b["conf"] > -1.0))
    best = F.filter(F.array(F.array_max(valid)), lambda b: b.isNotNull())
    return F.transform(best, lambda b: F.struct(b["conf"].alias("conf"), (-b["back"]).alias("pos"), expand(b["box"], w, h, ratio).alias("box")))


def best_box(boxes: Column, w: Column, h: Column, ratio: float = C.BOX_PADDING) -> Column:
    """The one of best_boxes(), null without one."""
    return F.get(best_boxes(boxes, w, h, ratio), 0)
