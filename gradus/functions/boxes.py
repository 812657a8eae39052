"""Bounding boxes as column expressions. Boxes are structs of integers x1, y1, x2, y2, half open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*(e.cast("int").alias(n) for e, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"), strict=True)))


def valid(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.coalesce((x2 > x1) & (y2 > y1), F.lit(False))


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]).cast("long") * (b["y2"] - b["y1"])


def clip(b: Column, height: Column, width: Column) -> Column:
    """b within the image; null if nothing of it is."""
    at = lambda e, most: F.greatest(F.lit(0), F.least(e, most))
    out = box(at(b["x1"], width), at(b["y1"], height), at(b["x2"], width), at(b["y2"], height))
    return F.when(area(out) > 0, out)


def scaled(b: Column, scale: float, height: Column, width: Column) -> Column:
    """b scaled about its centre, corners rounded half to even, clipped."""
    cx, cy = (b["x1"] + b["x2"]) / F.lit(2.0), (b["y1"] + b["y2"]) / F.lit(2.0)
    w, h = (F.greatest(F.lit(1.0), F.bround((b[e] - b[s]).cast("double") * F.lit(scale))) for s, e in (("x1", "x2"), ("y1", "y2")))
    return clip(box(F.bround(cx - w / 2), F.bround(cy - h / 2), F.bround(cx + w / 2), F.bround(cy + h / 2)), height, width)


def shifted(boxes: Column, crop: Column) -> Column:
    """Boxes in the coordinates of crop, clipped to it; those outside are dropped."""
    moved = F.transform(boxes, lambda b: clip(box(b["x1"] - crop["x1"], b["y1"] - crop["y1"], b["x2"] - crop["x1"], b["y2"] - crop["y1"]), crop["y2"] - crop["y1"], crop["x2"] - crop["x1"]))
    return F.filter(moved, lambda b: b.isNotNull())


def primary(boxes: Column) -> Column:
    """The largest box; the first of equals."""
    first = F.aggregate(boxes, F.lit(None).cast("struct<x1:int,y1:int,x2:int,y2:int>"), lambda best, b: F.when(best.isNull() | (area(b) > area(best)), b).otherwise(best))
    return first


def to_canvas(b: Column, laterality: Column, width: Column, crop_x: Column, crop_y: Column, scale: Column, canvas_h: int = 1024, canvas_w: int = 384) -> Column:
    """From the original image to the canvas: right breasts are mirrored, then the crop's origin is taken off, then scaled and rounded half to even."""
    flip = laterality == "R"
    x1, x2 = F.when(flip, width - b["x2"]).otherwise(b["x1"]), F.when(flip, width - b["x1"]).otherwise(b["x2"])
    at = lambda e, o: F.bround((e - o) * scale)
    return clip(box(at(x1, crop_x), at(b["y1"], crop_y), at(x2, crop_x), at(b["y2"], crop_y)), F.lit(canvas_h), F.lit(canvas_w))


def canvas_geometry(height: Column, width: Column, canvas_h: int = 1024, canvas_w: int = 384) -> dict[str, Column]:
    """scale, resized size and padding of an image on the canvas."""
    scale = F.least(F.lit(canvas_h) / height, F.lit(canvas_w) / width)
    rh, rw = F.bround(height * scale).cast("int"), F.bround(width * scale).cast("int")
    return {"scale": scale, "resized_h": rh, "resized_w": rw, "pad_bottom": F.lit(canvas_h) - rh, "pad_right": F.lit(canvas_w) - rw}
