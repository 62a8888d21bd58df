"""Arrays of detections as they sit in one frame row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from annolytics import settings
from annolytics.taxonomy import Taxonomy


def detections(class_ids: Column, confidences: Column, boxes: Column, taxonomy: Taxonomy) -> Column:
    """Zip raw model output into ARRAY<STRUCT<class_id, class_name, confidence, xyxy>>; confidence
    is rounded to 6 places and coordinates to 2 (half up)."""
    zipped = F.arrays_zip(class_ids.alias("c"), confidences.alias("p"), boxes.alias("b"))
    return F.transform(
        zipped,
        lambda d: F.struct(
            d["c"].cast("bigint").alias("class_id"),
            taxonomy.name_of(d["c"].cast("bigint")).alias("class_name"),
            F.round(d["p"], 6).alias("confidence"),
            F.transform(d["b"], lambda value: F.round(value, 2)).alias("xyxy"),
        ),
    )


def violations(found: Column, names: Sequence[str] = settings.VIOLATION_CLASSES) -> Column:
    """The detections of a violation class."""
    return F.filter(found, lambda d: d["class_name"].isin(*names))


def count_class(found: Column, name: str) -> Column:
    return F.size(F.filter(found, lambda d: d["class_name"] == name)).cast("bigint")
