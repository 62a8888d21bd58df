"""Choose images to look at, and describe them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.functions.boxes import pixel_corners
from annolytics.functions.labels import bad_lines, class_counts, valid_lines
from annolytics.functions.naming import preview_name
from annolytics.operators.ranking import first_per_group
from annolytics.taxonomy import Taxonomy


def preview_candidates(items: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Items that carry `lines` with `usable` (image readable, label present, at least one valid
    line), `invalid_lines`, `objects` and `class_counts`.  Bad lines are skipped and counted; an
    undecodable label counts as one."""
    opened = F.col("image_present") & F.col("image_readable") & F.col("label_present")
    valid = valid_lines(F.col("lines"))
    bad = F.when(F.col("label_text").isNull(), 1).otherwise(F.size(bad_lines(F.col("lines"))))
    objects = F.coalesce(F.size(valid), F.lit(0))
    return items.select(
        "split",
        "path",
        (opened & (objects > 0)).alias("usable"),
        F.when(opened, bad).otherwise(0).cast("bigint").alias("invalid_lines"),
        objects.cast("bigint").alias("objects"),
        class_counts(valid, taxonomy.ids).alias("class_counts"),
    )


def sample_preview(candidates: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """`n` usable items per split in a seeded hash order, with `rank` and `output_name`.  The choice
    depends on seed and path only."""
    if n < 1:
        raise ValueError("samples per split must be at least 1")
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("path")), 256)
    drawn = first_per_group(
        candidates.where("usable").withColumn("draw", draw), ["split"], ["draw", "path"], n
    )
    return (
        drawn.withColumn("output_name", preview_name(F.col("rank"), F.col("path")))
        .drop("draw", "usable")
    )


def preview_summary(
    candidates: DataFrame, sample: DataFrame, n: int, splits: Sequence[str]
) -> DataFrame:
    """Per split: requested, available, skipped images, invalid lines, images and objects shown,
    average objects per image, short (fewer than requested)."""
    available = candidates.groupBy("split").agg(
        F.count_if(F.col("usable")).alias("available"),
        F.count_if(~F.col("usable")).alias("skipped"),
        F.sum("invalid_lines").alias("invalid_lines"),
    )
    shown = sample.groupBy("split").agg(
        F.count("*").alias("images"), F.sum("objects").alias("objects")
    )
    zero = F.lit(0).cast("bigint")
    names = candidates.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    filled = names.join(available, "split", "left").join(shown, "split", "left")
    images, objects = F.coalesce("images", zero), F.coalesce("objects", zero)
    return filled.select(
        "split",
        F.lit(n).cast("bigint").alias("requested"),
        F.coalesce("available", zero).alias("available"),
        F.coalesce("skipped", zero).alias("skipped"),
        F.coalesce("invalid_lines", zero).alias("invalid_lines"),
        images.alias("images"),
        objects.alias("objects"),
        F.coalesce(F.round(F.try_divide(objects, images), 4), F.lit(0.0)).alias("average_objects"),
        (images < n).alias("short"),
    )


def preview_distribution(sample: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Objects per split and class of the sampled images, rolled up over splits (split null)."""
    rows = F.array(
        *(
            F.struct(
                F.lit(k).cast("bigint").alias("class_id"),
                F.lit(name).alias("class_name"),
                F.get("class_counts", i).alias("objects"),
            )
            for i, (k, name) in enumerate(taxonomy.names.items())
        )
    )
    long = sample.select("split", F.inline(rows))
    return (
        long.groupBy("class_id", "class_name", "split").agg(F.sum("objects").alias("objects"))
        .rollup("class_id", "class_name", "split")
        .agg(F.sum("objects").alias("objects"))
        .where(F.col("class_name").isNotNull())
    )


def pixel_boxes(annotations: DataFrame) -> DataFrame:
    """Annotations (x, y, w, h, width, height) to integer pixel corners inside the image."""
    corners = pixel_corners(*(F.col(c) for c in ("x", "y", "w", "h", "width", "height")))
    rest = [c for c in annotations.columns if c not in ("x", "y", "w", "h", "width", "height")]
    return annotations.withColumn("box", corners).select(*rest, "box.*")
