"""Box geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annolytics import settings


def is_finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def box_problem(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Why a normalised centre box is invalid, or null.  NaN is tested first because Spark orders
    it above every number."""
    slack = settings.EDGE_TOLERANCE
    finite = is_finite(x) & is_finite(y) & is_finite(w) & is_finite(h)
    return (
        F.when(~finite, settings.NOT_FINITE)
        .when(~(x.between(0.0, 1.0) & y.between(0.0, 1.0)), settings.CENTRE_OUTSIDE)
        .when(~((w > 0.0) & (w <= 1.0) & (h > 0.0) & (h <= 1.0)), settings.SIZE_OUTSIDE)
        .when(
            (x - w / 2 < -slack) | (x + w / 2 > 1.0 + slack)
            | (y - h / 2 < -slack) | (y + h / 2 > 1.0 + slack),
            settings.EDGE_OUTSIDE,
        )
    )


def corners(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Normalised centre box to a pixel corner box (struct x1, y1, x2, y2)."""
    return F.struct(
        ((x - w / 2) * width).alias("x1"),
        ((y - h / 2) * height).alias("y1"),
        ((x + w / 2) * width).alias("x2"),
        ((y + h / 2) * height).alias("y2"),
    )


def pixel_corners(
    x: Column, y: Column, w: Column, h: Column, width: Column, height: Column
) -> Column:
    """The same, rounded half to even and clamped to the image."""
    exact = corners(x, y, w, h, width, height)

    def pixel(name: str, size: Column) -> Column:
        rounded = F.rint(exact.getField(name)).cast("int")
        return F.greatest(F.lit(0), F.least(size.cast("int") - 1, rounded)).alias(name)

    return F.struct(
        pixel("x1", width), pixel("y1", height), pixel("x2", width), pixel("y2", height)
    )


def side(low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0.0), high - low)


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return side(x1, x2) * side(y1, y2)


def area_ratio(
    x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column
) -> Column:
    return area(x1, y1, x2, y2) / (width * height)


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two corner boxes; 0 when the union is empty."""
    ax1, ay1, ax2, ay2 = a
    bx1, by1, bx2, by2 = b
    shared = F.greatest(F.lit(0.0), F.least(ax2, bx2) - F.greatest(ax1, bx1)) * F.greatest(
        F.lit(0.0), F.least(ay2, by2) - F.greatest(ay1, by1)
    )
    union = area(ax1, ay1, ax2, ay2) + area(bx1, by1, bx2, by2) - shared
    return F.when(union != 0.0, shared / union).otherwise(0.0)


def confidence_band(
    confidence: Column,
    active: float = settings.ACTIVE_CONFIDENCE,
    low: float = settings.LOW_CONFIDENCE,
) -> Column:
    """`active`, `low`, or null below the floor."""
    if not 0.0 < low <= active < 1.0:
        raise ValueError("confidence limits must satisfy 0 < low <= active < 1")
    return F.when(confidence >= active, "active").when(confidence >= low, "low")
