"""Precision, recall and average precision.

The definition is this library's own, in the published 101-point style.  Predictions are matched
greedily by IoU within image and class, once, at the lowest threshold: the matches at a higher
threshold are exactly those that reach it.  Predictions of equal confidence form one point of the
precision-recall curve, so the result does not depend on how ties are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annolytics import settings
from annolytics.operators.matching import greedy_match, match_candidates, with_match
from annolytics.operators.running import exact_percentiles, join_on, ordered_totals
from annolytics.session import cut_lineage
from annolytics.taxonomy import Taxonomy

IOU_THRESHOLDS = tuple(t / 100 for t in range(50, 100, 5))


def prediction_count(
    predictions: DataFrame, floor: float = settings.EVALUATION_CONFIDENCE
) -> DataFrame:
    return predictions.where(F.col("conf") >= floor).agg(F.count("*").alias("prediction_boxes"))


def matched_predictions(
    truth: DataFrame,
    predictions: DataFrame,
    floor: float = settings.EVALUATION_CONFIDENCE,
    min_iou: float = IOU_THRESHOLDS[0],
) -> DataFrame:
    """image_id, class_id, idx, conf, match_iou of every prediction above the confidence floor."""
    kept = predictions.where(F.col("conf") >= floor)
    matches = greedy_match(match_candidates(truth, kept, min_iou))
    return with_match(kept.select("image_id", "class_id", "idx", "conf"), matches, "pi")


def _hit(threshold: float) -> str:
    return f"tp_{round(threshold * 100)}"


def precision_recall_curve(
    matched: DataFrame, truth: DataFrame, thresholds: Sequence[float] = IOU_THRESHOLDS
) -> DataFrame:
    """class_id, iou_threshold, conf, tp, predicted, truth_count, precision, recall: one point per
    class, threshold and distinct confidence, cumulated from the highest confidence down."""
    hits = [_hit(t) for t in thresholds]
    points = cut_lineage(
        matched.groupBy("class_id", "conf").agg(
            F.count("*").alias("predicted"),
            *(F.count_if(F.col("match_iou") >= t).alias(h) for t, h in zip(thresholds, hits)),
        )
    )
    totals = ordered_totals(points, ["class_id"], -F.col("conf"), ["predicted", *hits])
    per_class = truth.groupBy("class_id").agg(F.count("*").alias("truth_count"))
    long = totals.join(per_class, "class_id").select(
        "class_id",
        "conf",
        "truth_count",
        F.col("predicted_upto").alias("predicted"),
        F.inline(
            F.array(
                *(
                    F.struct(F.lit(t).alias("iou_threshold"), F.col(f"{h}_upto").alias("tp"))
                    for t, h in zip(thresholds, hits)
                )
            )
        ),
    )
    return long.select(
        "class_id",
        "iou_threshold",
        "conf",
        "tp",
        "predicted",
        "truth_count",
        (F.col("tp") / F.col("predicted")).alias("precision"),
        (F.col("tp") / F.col("truth_count")).alias("recall"),
    )


def average_precision(curve: DataFrame) -> DataFrame:
    """class_id, iou_threshold, ap: mean over the recalls 0.00 ... 1.00 of the best precision at
    that recall or beyond."""
    recall = F.col("recall")
    guess = F.floor(recall * 100).cast("int")
    # `recall * 100` may round across a step: settle it by comparing with the step itself.
    reached = (
        F.when(recall >= (guess + 1) / F.lit(100.0), guess + 1)
        .when(recall >= guess / F.lit(100.0), guess)
        .otherwise(guess - 1)
    )
    best = (
        curve.withColumn("step", F.least(F.lit(100), reached))
        .groupBy("class_id", "iou_threshold", "step")
        .agg(F.max("precision").alias("precision"))
    )
    # At most 101 rows per class and threshold from here on.  A step stands for all lower recalls
    # up to the next lower step that occurs.
    onward = (
        Window.partitionBy("class_id", "iou_threshold")
        .orderBy(F.desc("step"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    lower = Window.partitionBy("class_id", "iou_threshold").orderBy("step")
    return (
        best.withColumn("envelope", F.max("precision").over(onward))
        .withColumn("covers", F.col("step") - F.coalesce(F.lag("step").over(lower), F.lit(-1)))
        .groupBy("class_id", "iou_threshold")
        .agg((F.sum(F.col("envelope") * F.col("covers")) / 101.0).alias("ap"))
    )


def detection_metrics(
    matched: DataFrame,
    truth: DataFrame,
    taxonomy: Taxonomy,
    confidence: float = settings.ACTIVE_CONFIDENCE,
) -> DataFrame:
    """Per class: precision and recall at IoU 0.50 and the given confidence, AP@50 and AP@50-95;
    every declared class has a row, zeros where nothing was found."""
    matched = cut_lineage(matched)
    ap = average_precision(precision_recall_curve(matched, truth))
    ap = ap.groupBy("class_id").agg(
        F.max(F.when(F.col("iou_threshold") == IOU_THRESHOLDS[0], F.col("ap"))).alias("ap50"),
        F.avg("ap").alias("ap50_95"),
    )
    used = F.col("conf") >= confidence
    found = matched.groupBy("class_id").agg(
        F.count_if(used).alias("predicted"),
        F.count_if(used & (F.col("match_iou") >= IOU_THRESHOLDS[0])).alias("tp"),
    )
    there = truth.groupBy("class_id").agg(F.count("*").alias("truth_count"))
    joined = (
        taxonomy.table(truth.sparkSession)
        .join(found, "class_id", "left")
        .join(there, "class_id", "left")
        .join(ap, "class_id", "left")
    )
    zero = F.lit(0.0)
    return joined.select(
        "class_id",
        "class_name",
        F.coalesce(F.try_divide("tp", "predicted"), zero).alias("precision"),
        F.coalesce(F.try_divide("tp", "truth_count"), zero).alias("recall"),
        F.coalesce("ap50", zero).alias("ap50"),
        F.coalesce("ap50_95", zero).alias("ap50_95"),
    )


def mean_metrics(per_class: DataFrame) -> DataFrame:
    return per_class.agg(
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("ap50").alias("map50"),
        F.avg("ap50_95").alias("map50_95"),
    )


def latency_summary(
    log: DataFrame, group: Sequence[str], latency: str, stages: Sequence[str] = ()
) -> DataFrame:
    """Samples, mean, P50 and P95 (linear interpolation) of a latency column per group, and the mean
    of every stage column as `mean_<stage>`.  Groups without a latency stay, with null percentiles."""
    means = log.groupBy(*group).agg(
        F.count(latency).alias("samples"),
        F.avg(latency).alias("mean_ms"),
        *(F.avg(stage).alias(f"mean_{stage}") for stage in stages),
    )
    percentiles = exact_percentiles(log, group, latency, {"p50_ms": 0.50, "p95_ms": 0.95})
    return join_on(means, percentiles, list(group), "left")
