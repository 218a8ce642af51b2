"""Boxes as four Columns (x1, y1, x2, y2) and what is computed from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def scaled(x: Column, y: Column, w: Column, h: Column, sx: Column, sy: Column) -> Box:
    return x * sx, y * sy, (x + w) * sx, (y + h) * sy


def widened(box: Box, left: Column, top: Column, right: Column, bottom: Column, least: float | None = None) -> Box:
    """The box moved outward by shares of its sides; with `least`, sides count as that long at least."""
    w, h = box[2] - box[0], box[3] - box[1]
    if least is not None:
        w, h = F.greatest(w, F.lit(least)), F.greatest(h, F.lit(least))
    return box[0] - w * left, box[1] - h * top, box[2] + w * right, box[3] + h * bottom


def covered(block: Box, field: Box) -> Column:
    """The share of the block's area (1 at least) that lies in the field."""
    w = F.least(block[2], field[2]) - F.greatest(block[0], field[0])
    h = F.least(block[3], field[3]) - F.greatest(block[1], field[1])
    area = F.greatest((block[2] - block[0]) * (block[3] - block[1]), F.lit(1.0))
    return F.when((w > 0) & (h > 0), w * h / area).otherwise(F.lit(0.0))


def inside(x: Column, y: Column, box: Box) -> Column:
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def nearness(x: Column, y: Column, box: Box) -> Column:
    """1 in the middle of the box, 0 from 1.35 diagonals on."""
    dx, dy = x - (box[0] + box[2]) / 2, y - (box[1] + box[3]) / 2
    w, h = box[2] - box[0], box[3] - box[1]
    diagonal = F.sqrt(w * w + h * h)
    diagonal = F.when(diagonal == 0, F.lit(1.0)).otherwise(diagonal)
    return F.greatest(F.lit(0.0), 1.0 - F.sqrt(dx * dx + dy * dy) / (diagonal * 1.35))


def pixels(box: Box, width: Column, height: Column) -> dict[str, Column]:
    """x, y, w, h in whole pixels inside an image, a pixel wide and high at least; halves round to even."""
    at = lambda c: F.rint(c).cast("int")
    x = F.greatest(F.lit(0), F.least(width - 1, at(box[0])))
    y = F.greatest(F.lit(0), F.least(height - 1, at(box[1])))
    x2 = F.greatest(x + 1, F.least(width, at(box[2])))
    y2 = F.greatest(y + 1, F.least(height, at(box[3])))
    return {"x": x, "y": y, "w": x2 - x, "h": y2 - y}


def to_image(box: Box, image_w: Column, image_h: Column, page_w: Column, page_h: Column) -> dict[str, Column]:
    """Page coordinates in image pixels; a double-width image whose left half has the page's shape shows the page there."""
    least_h = F.greatest(image_h.cast("double"), F.lit(1.0))
    half = image_w / 2.0
    left = (image_w >= image_h * 2) & (F.abs(half / least_h - page_w / F.greatest(page_h, F.lit(1.0))) < 0.35)
    sx = F.when(left, half).otherwise(image_w.cast("double")) / F.greatest(page_w, F.lit(1.0))
    sy = image_h.cast("double") / F.greatest(page_h, F.lit(1.0))
    return pixels((box[0] * sx, box[1] * sy, box[2] * sx, box[3] * sy), image_w, image_h)
