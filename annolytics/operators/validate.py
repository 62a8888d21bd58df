"""Audit of an annotated dataset: issues, counts, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolytics import settings
from annolytics.functions.labels import bad_lines, class_counts, valid_lines
from annolytics.taxonomy import Taxonomy

ISSUE = (
    "struct<severity:string,code:string,message:string,split:string,image_path:string,"
    "label_path:string,line:int>"
)
ISSUE_COLUMNS = ["severity", "code", "message", "split", "image_path", "label_path", "line"]


def issue(
    code: str, message, split=None, image_path=None, label_path=None, line=None
) -> Column:
    return F.struct(
        F.lit(settings.ISSUE_SEVERITY[code]).alias("severity"),
        F.lit(code).alias("code"),
        F.lit(message).alias("message"),
        F.lit(split).alias("split"),
        F.lit(image_path).alias("image_path"),
        F.lit(label_path).alias("label_path"),
        F.lit(line).alias("line"),
    ).cast(ISSUE)


def item_issues(items: DataFrame) -> DataFrame:
    """Everything wrong with single images and their labels, found in one pass over items that
    carry `lines`.  A missing image is reported alone; an unreadable one still has its label
    checked."""
    split, path, label = F.col("split"), F.col("path"), F.col("label_path")
    present, readable = F.col("image_present"), F.col("image_readable")
    has_label, text = F.col("label_present"), F.col("label_text")

    def only_if(condition: Column, found: Column) -> Column:
        return F.when(condition, F.array(found)).otherwise(F.array().cast(f"array<{ISSUE}>"))

    of_lines = F.transform(
        F.coalesce(bad_lines(F.col("lines")), F.array().cast(_LINES)),
        lambda line: F.struct(
            F.lit("error").alias("severity"),
            line["code"].alias("code"),
            line["message"].alias("message"),
            split.alias("split"),
            path.alias("image_path"),
            label.alias("label_path"),
            line["line_no"].alias("line"),
        ).cast(ISSUE),
    )
    found = F.when(
        ~present, F.array(issue("missing_image", "Image listed in split does not exist.", split, path))
    ).otherwise(
        F.concat(
            only_if(~readable, issue("unreadable_image", "Image cannot be decoded.", split, path)),
            only_if(
                ~has_label,
                issue("missing_label", "No matching YOLO label file was found.", split, path, label),
            ),
            only_if(
                has_label & text.isNull(),
                issue(
                    "unreadable_label",
                    "Label file cannot be read as UTF-8 text.", split, path, label,
                ),
            ),
            only_if(
                F.size("lines") == 0,
                issue(
                    "empty_label",
                    "Label file contains no annotations; this may be a valid negative image.",
                    split, path, label,
                ),
            ),
            of_lines,
        )
    )
    return items.select(F.inline(found))


_LINES = (
    "array<struct<line_no:int,fields:array<string>,class_id:bigint,box:array<double>,"
    "code:string,message:string>>"
)


def duplicate_contents(items: DataFrame) -> DataFrame:
    """digest, copies, splits of every content that occurs more than once.  The members stay a
    long table (`duplicate_members`): a group may hold any share of the data."""
    return (
        items.where(F.col("digest").isNotNull())
        .groupBy("digest")
        .agg(F.count("*").alias("copies"), F.array_sort(F.collect_set("split")).alias("splits"))
        .where(F.col("copies") > 1)
    )


def duplicate_members(items: DataFrame) -> DataFrame:
    """digest, copies, split, path: one row per occurrence of a duplicated content."""
    groups = duplicate_contents(items).select("digest", "copies")
    return items.join(groups, "digest").select("digest", "copies", "split", "path")


def duplicate_issues(items: DataFrame) -> DataFrame:
    message = F.concat(
        F.lit("Identical image content appears "),
        F.col("copies").cast("string"),
        F.lit(" times (SHA-256: "),
        F.col("digest"),
        F.lit(")."),
    )
    found = duplicate_contents(items).select(issue("duplicate_image", message).alias("i"))
    return found.select("i.*")


def all_issues(items: DataFrame, source_issues: DataFrame | None = None) -> DataFrame:
    """Issues of items and of duplicated contents, and those found while resolving the sources."""
    found = item_issues(items).unionByName(duplicate_issues(items))
    return found if source_issues is None else found.unionByName(source_issues)


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity", "code").agg(F.count("*").alias("issues"))


def dataset_is_valid(issues: DataFrame) -> DataFrame:
    """One row: errors, warnings, valid."""
    errors = F.count_if(F.col("severity") == "error")
    return issues.agg(
        errors.alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        (errors == 0).alias("valid"),
    )


def split_counts(items: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Per split: images (missing files included), images present, label files, lines, valid lines,
    and two arrays in id order: valid annotations and images per class.  A single pass whose
    partial sums are a handful of numbers per split and task."""
    ids = taxonomy.ids
    usable = F.col("image_present")
    lines = F.when(usable, F.col("lines"))
    counted = items.select(
        "split",
        usable.cast("int").alias("present"),
        (usable & F.col("label_present")).cast("int").alias("label"),
        F.coalesce(F.size(lines), F.lit(0)).alias("total"),
        class_counts(valid_lines(lines), ids).alias("n"),
    )
    per_class = [F.coalesce(F.get("n", i), F.lit(0)) for i in range(len(ids))]
    return counted.groupBy("split").agg(
        F.count("*").alias("images"),
        F.sum("present").alias("images_present"),
        F.sum("label").alias("label_files"),
        F.sum("total").alias("annotation_lines"),
        F.array(*(F.sum(c) for c in per_class)).alias("annotations_by_class"),
        F.array(*(F.count_if(c > 0) for c in per_class)).alias("images_by_class"),
    )


def class_grid(
    counts: DataFrame, taxonomy: Taxonomy, splits: Sequence[str]
) -> DataFrame:
    """split, class_id, class_name, annotations, images: the full grid, zeros included."""
    spark = counts.sparkSession
    grid = spark.createDataFrame(
        [(s, i, k, taxonomy.names[k]) for s in splits for i, k in enumerate(taxonomy.ids)],
        "split string, position int, class_id long, class_name string",
    )
    zero = F.lit(0).cast("bigint")
    return grid.join(
        counts.select("split", "annotations_by_class", "images_by_class"), "split", "left"
    ).select(
        "split",
        "class_id",
        "class_name",
        F.coalesce(F.get("annotations_by_class", F.col("position")), zero).alias("annotations"),
        F.coalesce(F.get("images_by_class", F.col("position")), zero).alias("images"),
    )


def class_totals(grid: DataFrame) -> DataFrame:
    """Per class and overall sums of the grid; `split` and class are null on rolled-up rows.  An
    image that sits in two splits counts in both."""
    return grid.rollup("class_id", "split").agg(
        F.sum("annotations").alias("annotations"), F.sum("images").alias("images")
    )


def class_shares(grid: DataFrame) -> DataFrame:
    """Share of each class in all annotations; 0 when there are none."""
    totals = grid.groupBy("class_id", "class_name").agg(F.sum("annotations").alias("annotations"))
    everything = totals.agg(F.sum("annotations").alias("n")).scalar()
    return totals.withColumn(
        "share", F.coalesce(F.try_divide(F.col("annotations"), everything), F.lit(0.0))
    )
