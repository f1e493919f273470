"""Box arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CORNERS = ("x1", "y1", "x2", "y2")


def corners(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in CORNERS]


def fields(box: Column) -> list[Column]:
    return [box[c] for c in CORNERS]


def _side(low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0.0), high - low)


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union; 0 when the boxes do not overlap."""
    inter = _side(F.greatest(a[0], b[0]), F.least(a[2], b[2])) * _side(
        F.greatest(a[1], b[1]), F.least(a[3], b[3])
    )
    union = _side(a[0], a[2]) * _side(a[1], a[3]) + _side(b[0], b[2]) * _side(b[1], b[3]) - inter
    return F.when((inter <= 0) | (union <= 0), F.lit(0.0)).otherwise(inter / union)


def has_area(prefix: str = "") -> Column:
    x1, y1, x2, y2 = corners(prefix)
    return (x2 > x1) & (y2 > y1)


def centre_to_corners(cx: Column, cy: Column, w: Column, h: Column) -> list[Column]:
    half_w, half_h = F.lit(0.5) * w, F.lit(0.5) * h
    return [cx - half_w, cy - half_h, cx + half_w, cy + half_h]


def sigmoid(x: Column) -> Column:
    """Logistic function that never exponentiates a positive number."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def points_to_pixels(x: Column, y: Column, w: Column, h: Column, page_height: Column, dpi: Column) -> list[Column]:
    """Bottom-left points to top-left pixels, two decimals."""
    per_point = dpi / F.lit(72.0)
    return [
        F.round(x * per_point, 2),
        F.round((page_height - (y + h)) * per_point, 2),
        F.round((x + w) * per_point, 2),
        F.round((page_height - y) * per_point, 2),
    ]
