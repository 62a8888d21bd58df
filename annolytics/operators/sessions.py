"""Detections aggregated per session.  The batch and the streaming form share these expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolytics import settings
from annolytics.functions.detections import count_class, violations
from annolytics.operators.ranking import first_per_group
from annolytics.taxonomy import Taxonomy


def summary_aggregates(
    taxonomy: Taxonomy, violation_names: Sequence[str] = settings.VIOLATION_CLASSES
) -> list[Column]:
    """Plain numeric aggregates over frame rows, so that every task folds its share of a session."""
    found = F.col("detections")
    bad = F.size(violations(found, violation_names))
    return [
        F.count("*").alias("frames_processed"),
        F.count_if(bad > 0).alias("frames_with_violations"),
        F.sum(F.size(found)).alias("total_detection_events"),
        F.sum(bad).alias("violation_detection_events"),
        F.max(F.size(found)).alias("max_detections_in_frame"),
        F.max(bad).alias("max_violations_in_frame"),
        *(
            F.sum(count_class(found, name)).alias(f"n_{k}")
            for k, name in taxonomy.names.items()
        ),
    ]


def finish_summary(
    sums: DataFrame,
    taxonomy: Taxonomy,
    keys: Sequence[str],
    violation_names: Sequence[str] = settings.VIOLATION_CLASSES,
) -> DataFrame:
    """Counts per class as maps in name order: all classes seen, and every violation class."""
    ordered = sorted(taxonomy.names.items(), key=lambda pair: pair[1])

    def entry(class_id: int, name: str) -> Column:
        return F.struct(F.lit(name).alias("key"), F.col(f"n_{class_id}").alias("value"))

    counted = F.array(*(entry(k, name) for k, name in ordered))
    wanted = F.array(*(entry(k, name) for k, name in ordered if name in violation_names))
    status = F.when(F.col("violation_detection_events") > 0, "violation_detected").otherwise(
        "no_violation_detected"
    )
    return sums.select(
        *keys,
        status.alias("status"),
        "frames_processed",
        "frames_with_violations",
        "total_detection_events",
        "violation_detection_events",
        F.col("max_detections_in_frame").cast("bigint").alias("max_detections_in_frame"),
        F.col("max_violations_in_frame").cast("bigint").alias("max_violations_in_frame"),
        F.map_from_entries(F.filter(counted, lambda e: e["value"] > 0)).alias("class_counts"),
        F.map_from_entries(wanted).alias("violation_counts"),
    )


def session_summary(frames: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """`frames`: session_id, frame, detections (ARRAY<STRUCT<class_name, ...>>).  Frames without any
    detection count as frames."""
    sums = frames.groupBy("session_id").agg(*summary_aggregates(taxonomy))
    return finish_summary(sums, taxonomy, ["session_id"])


def usable_fps(fps: Column) -> Column:
    return F.when(fps > 0, fps.cast("double")).otherwise(settings.DEFAULT_FPS)


def violation_frames(
    frames: DataFrame, meta: DataFrame, k: int = settings.VIOLATION_SAMPLES
) -> DataFrame:
    """The first `k` frames with a violation per session: session_id, frame, time_seconds,
    violations.  `meta`: session_id, fps."""
    bad = violations(F.col("detections"))
    hits = frames.select("session_id", "frame", bad.alias("violations")).where(F.size("violations") > 0)
    sampled = first_per_group(hits, ["session_id"], ["frame"], k).drop("rank")
    return sampled.join(meta.select("session_id", "fps"), "session_id", "left").select(
        "session_id",
        "frame",
        F.round(F.col("frame") / usable_fps(F.col("fps")), 3).alias("time_seconds"),
        "violations",
    )


def session_limits(
    frames: DataFrame, meta: DataFrame, max_seconds: float = settings.MAX_VIDEO_SECONDS
) -> DataFrame:
    """session_id, fps, frames, duration_seconds, verdict per session of `meta`: `ok`, `no_frames`,
    `too_long` (declared frame_total over the limit, if the column exists) or `too_many_frames`."""
    counted = frames.groupBy("session_id").agg(F.count("*").alias("frames"))
    fps = usable_fps(F.col("fps"))
    number = F.coalesce("frames", F.lit(0))
    most = F.greatest(F.lit(1), F.floor(F.lit(max_seconds) * fps))
    declared = F.col("frame_total") if "frame_total" in meta.columns else F.lit(None).cast("bigint")
    verdict = (
        F.when(F.coalesce(F.greatest(declared, F.lit(0)) / fps > max_seconds, F.lit(False)), "too_long")
        .when(number > most, "too_many_frames")
        .when(number == 0, "no_frames")
        .otherwise("ok")
    )
    return meta.join(counted, "session_id", "left").select(
        "session_id",
        F.round(fps, 3).alias("fps"),
        number.alias("frames"),
        F.round(number / fps, 3).alias("duration_seconds"),
        verdict.alias("verdict"),
    )


def violation_rates(frames: DataFrame, width: str = "1 hour") -> DataFrame:
    """Per time window and violation class: frames in the window and detections of the class.
    Works on batch and streaming frames (`ts` must be a TIMESTAMP there, with a watermark)."""
    counts = [
        F.sum(count_class(F.col("detections"), name)).alias(name)
        for name in settings.VIOLATION_CLASSES
    ]
    windowed = frames.groupBy(F.window("ts", width)).agg(F.count("*").alias("frames"), *counts)
    rows = F.array(
        *(
            F.struct(F.lit(name).alias("class_name"), F.col(name).alias("detections"))
            for name in settings.VIOLATION_CLASSES
        )
    )
    return windowed.select(
        F.col("window.start").alias("window_start"), "frames", F.inline(rows)
    )
