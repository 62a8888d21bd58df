"""Heuristic error categories per image, and examples to look at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics import settings
from annolytics.functions.boxes import area_ratio, confidence_band
from annolytics.operators.matching import (
    confused_within,
    confusion_counts,
    gathered,
    greedy_match,
    match_candidates,
    occluded_within,
    overlapping_truth,
    unmatched,
    with_left_over,
)
from annolytics.operators.ranking import first_per_group
from annolytics.operators.spatial import crowded_images
from annolytics.session import cut_lineage


def image_errors(
    truth: DataFrame,
    predictions: DataFrame,
    active: float = settings.ACTIVE_CONFIDENCE,
    low: float = settings.LOW_CONFIDENCE,
    min_iou: float = settings.MATCH_IOU,
) -> DataFrame:
    """One row per image with an event count per category.

    `truth`: image_id, idx, class_id, x1..y2, width, height.  `predictions`: the same box columns
    and conf.  Images without any box have no row; they cannot have errors.
    """
    banded = predictions.withColumn("band", confidence_band(F.col("conf"), active, low))
    in_use = banded.where(F.col("band") == "active").drop("band")
    ratio = area_ratio(*(F.col(c) for c in ("x1", "y1", "x2", "y2", "width", "height")))
    small = (ratio < settings.SMALL_AREA_RATIO).cast("int")
    truth = truth.withColumn("small", small).drop("width", "height")
    seldom = _counted(banded.where(F.col("band") == "low"), low=F.lit(1)).groupBy("image_id")
    parts = [seldom.agg(*(F.sum(name).alias(name) for name in _COUNTERS))]
    crowded = crowded_images("image_id", truth, in_use, unnamed=True)
    if crowded is None:
        parts.append(_errors_within(truth, in_use, min_iou))
    else:
        here = F.col("image_id").eqNullSafe(F.col("crowded"))
        crowded = crowded.withColumnRenamed("image_id", "crowded")
        few, many = ([side.join(crowded, here, how) for side in (truth, in_use)] for how in ("left_anti", "left_semi"))
        parts.append(_errors_within(*few, min_iou))
        parts.extend(_errors_across(*many, min_iou))
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    sums = stacked.groupBy("image_id").agg(
        *(F.sum(name).alias(name) for name in _COUNTERS)
    )
    either = F.col("missed") + F.col("extra")
    events = {
        "low_confidence": F.col("low"),
        "suspected_missed_detection": F.col("missed"),
        "suspected_false_positive": F.col("extra"),
        "class_confusion": F.col("confused"),
        "small_object_failure": F.col("small"),
        "occlusion_scene_failure": F.col("occluded"),
        "dense_scene_failure": F.when(F.col("objects") >= settings.DENSE_OBJECTS, either).otherwise(0),
    }
    return sums.select(
        "image_id", *(events[name].cast("bigint").alias(name) for name in settings.ERROR_CATEGORIES)
    )


def _errors_within(truth: DataFrame, in_use: DataFrame, min_iou: float) -> DataFrame:
    """Counters of images with few boxes: their boxes move once, and every step runs in the row of the image."""
    images = with_left_over(gathered(truth, in_use, "small"), min_iou)
    return _counted(
        images,
        objects=F.size("truths"),
        missed=F.size("missed_boxes"),
        small=F.size(F.filter("missed_boxes", lambda box: box["small"] > 0)),
        extra=F.size("extra_boxes"),
        confused=confused_within("missed_boxes", "extra_boxes", min_iou),
        occluded=occluded_within("missed_boxes", "truths"),
    )


def _errors_across(truth: DataFrame, in_use: DataFrame, min_iou: float) -> list[DataFrame]:
    """Counters of crowded images, whose boxes spread over tasks, and of boxes that name no image."""
    matches = greedy_match(match_candidates(truth, in_use, min_iou))
    # Both are read several times below.
    missed = cut_lineage(unmatched(truth, matches, "gi"))
    extra = cut_lineage(unmatched(in_use, matches, "pi"))
    one = F.lit(1)
    return [
        _counted(truth, objects=one),
        _counted(missed, missed=one, small=F.col("small")),
        _counted(extra, extra=one),
        _counted(confusion_counts(missed, extra, min_iou), confused=F.col("confused")),
        _counted(overlapping_truth(missed, truth), occluded=one),
    ]


_COUNTERS = ("objects", "low", "missed", "small", "extra", "confused", "occluded")


def _counted(df: DataFrame, **counters) -> DataFrame:
    return df.select(
        "image_id",
        *(counters.get(name, F.lit(0)).cast("bigint").alias(name) for name in _COUNTERS),
    )


def _by_category(errors: DataFrame) -> DataFrame:
    pairs = F.array(
        *(
            F.struct(F.lit(name).alias("category"), F.col(name).alias("events"))
            for name in settings.ERROR_CATEGORIES
        )
    )
    return errors.select("image_id", F.inline(pairs))


def error_categories(errors: DataFrame) -> DataFrame:
    """Events and affected images of every category, including those with none."""
    totals = errors.agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_e") for c in settings.ERROR_CATEGORIES),
        *(F.count_if(F.col(c) > 0).alias(f"{c}_i") for c in settings.ERROR_CATEGORIES),
    )
    return totals.select(
        F.inline(
            F.array(
                *(
                    F.struct(
                        F.lit(c).alias("category"),
                        F.col(f"{c}_e").cast("bigint").alias("events"),
                        F.col(f"{c}_i").cast("bigint").alias("images"),
                    )
                    for c in settings.ERROR_CATEGORIES
                )
            )
        )
    )


def error_examples(
    errors: DataFrame, order: str = "image_id", k: int = settings.EXAMPLES_PER_CATEGORY
) -> DataFrame:
    """The first `k` affected images of every category."""
    return first_per_group(_by_category(errors).where(F.col("events") > 0), ["category"], [order], k)
