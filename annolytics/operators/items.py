"""Images joined with their label files, one row per image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.functions.boxes import corners
from annolytics.functions.content import digest, image_size, looks_like_image, utf8_text
from annolytics.functions.labels import parse_lines
from annolytics.functions.paths import label_path
from annolytics.taxonomy import Taxonomy


def image_facts(images: DataFrame, algorithm: str = "sha256", sizes: bool = False) -> DataFrame:
    """`content` (null when a listed file does not exist) reduced to image_present, image_readable (a
    signature test) and digest, with `sizes` to width and height too; other columns stay.  To be done
    before anything is shuffled."""
    content = F.col("content")
    if sizes:
        images = images.withColumn("_size", image_size(content)).selectExpr(
            *(f"`{c}`" for c in images.columns), "_size.width AS width", "_size.height AS height"
        )
    return images.select(
        *(c for c in images.columns if c != "content"),
        content.isNotNull().alias("image_present"),
        looks_like_image(content).alias("image_readable"),
        digest(content, algorithm).alias("digest"),
    )


def join_labels(facts: DataFrame, label_files: DataFrame, root: str) -> DataFrame:
    """`facts`: split, path and what `image_facts` made; `label_files`: label_path, content.  The join
    on the label path keeps images without a label file.

    Both sides are dealt to all shuffle partitions: parsing the texts takes far longer than moving them, and adaptive
    execution, which looks at sizes only, would leave little more than one task a core.
    """
    left = facts.withColumn("label_path", label_path(F.col("path"), root))
    right = label_files.select(
        "label_path",
        F.lit(True).alias("label_present"),
        utf8_text(F.col("content")).alias("label_text"),
    )
    tasks = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (side.repartition(tasks, "label_path") for side in (left, right))
    return left.join(right, "label_path", "left").withColumn(
        "label_present", F.coalesce("label_present", F.lit(False))
    )


def annotated_items(
    images: DataFrame, label_files: DataFrame, root: str, algorithm: str = "sha256", sizes: bool = False
) -> DataFrame:
    """`images`: split, path, content and any further columns; `label_files`: label_path, content."""
    return join_labels(image_facts(images, algorithm, sizes), label_files, root)


def with_lines(items: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Add `lines`, the parsed label lines; null where there is no readable label."""
    return items.withColumn("lines", parse_lines(F.col("label_text"), taxonomy))


def annotations(items: DataFrame) -> DataFrame:
    """Valid annotations, one row each, of items that carry `lines`."""
    keep = [c for c in items.columns if c not in ("lines", "label_text")]
    exploded = items.select(*keep, F.explode("lines").alias("line")).where("line.code is null")
    return exploded.select(
        *keep,
        "line.line_no",
        "line.class_id",
        *(F.get("line.box", i).alias(name) for i, name in enumerate("xywh")),
    )


def truth_boxes(items: DataFrame, image: str = "path") -> DataFrame:
    """The valid annotations of items with `lines`, width and height as boxes in pixels: image_id, idx (the
    line), class_id, x1..y2, width, height.  An image of unknown size that has annotations is an error."""
    unknown = F.raise_error(F.concat(F.lit("image size is unknown: "), F.col("path"))).cast("int")
    sized = annotations(items).withColumn("width", F.coalesce("width", unknown))
    box = corners(*(F.col(c) for c in ("x", "y", "w", "h", "width", "height")))
    return sized.select(
        F.col(image).alias("image_id"),
        F.col("line_no").cast("bigint").alias("idx"),
        "class_id",
        box.alias("box"),
        "width",
        "height",
    ).select("image_id", "idx", "class_id", "box.*", "width", "height")
