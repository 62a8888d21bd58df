"""Scans of image folders, list files and label files."""

from __future__ import annotations

import posixpath
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annolytics import settings
from annolytics.functions.paths import folder_name, has_image_suffix, label_path, normal_path, plain_path
from annolytics.functions.text import strip
from annolytics.operators.items import image_facts
from annolytics.sources.spec import DatasetSpec, issue_rows
from annolytics.sources.storage import file_status, listed_paths



def _facts(sizes: bool) -> str:
    """The columns of `image_facts`."""
    found = "path string, image_present boolean, image_readable boolean, digest string"
    return f"{found}, width int, height int" if sizes else found


def scan_files(spark: SparkSession, folders: str | Sequence[str], glob: str, below: bool = True) -> DataFrame:
    """path, content of the files in some folders, or anywhere `below` them, whose names match.

    A file scan leaves empty files out, but an empty label is a statement of its own.  They are added
    from the scan's listing.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(below).lower())
        .option("pathGlobFilter", glob)
        .load([folders] if isinstance(folders, str) else list(folders))
    )
    filled = files.select(plain_path(F.col("path")).alias("path"), "content")
    listed = listed_paths(files).select(plain_path(F.col("path")).alias("path"))
    empty = listed.join(filled.select("path"), "path", "left_anti")
    return filled.unionByName(empty.withColumn("content", F.lit(b"")))


def scan_folder(spark: SparkSession, folders: str | Sequence[str], below: bool = True) -> DataFrame:
    """path, content of every image below a folder.  The suffix is tested on the listing, before any
    file is opened."""
    return scan_files(spark, folders, _image_glob(), below).where(has_image_suffix(F.col("path")))


def existing_folders(spark: SparkSession, *paths: Column, of: DataFrame) -> list[str]:
    """The distinct folders of the files that `paths` name, as far as they exist.  A file scan keeps
    its folders on the driver in any case; no file names pass there."""
    named = of.select(F.explode(F.array(*map(folder_name, paths))).alias("folder")).distinct()
    return [f for f in sorted(row.folder for row in named.collect()) if file_status(spark, f) == "folder"]


def _image_glob() -> str:
    def any_case(text: str) -> str:
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in text)

    return "*{" + ",".join(any_case(e) for e in settings.IMAGE_EXTENSIONS) + "}"


def read_list_file(spark: SparkSession, list_file: str, root: str) -> DataFrame:
    """The entries of a list file, two candidate paths each: absolute entries as they are, others
    below `root` and below the folder of the list.  Blank lines and `#` lines are skipped."""
    entry = strip(F.col("value"))
    lines = spark.read.text(list_file).select(entry.alias("entry"))
    lines = lines.where((F.col("entry") != "") & ~F.startswith("entry", F.lit("#")))
    absolute = F.startswith("entry", F.lit("/")) | F.contains("entry", F.lit("://"))

    def below(folder: str):
        joined = F.concat(F.lit(folder.rstrip("/") + "/"), F.col("entry"))
        return normal_path(F.when(absolute, F.col("entry")).otherwise(joined))

    return lines.select(
        below(root).alias("root_path"), below(posixpath.dirname(list_file)).alias("list_path")
    )


def resolve_list(entries: DataFrame, facts: DataFrame) -> DataFrame:
    """The facts of listed files: of the candidate below the root if it exists, else of the one next
    to the list, which is not present when that is missing too.  `facts`: path and `image_facts`."""
    known = [c for c in facts.columns if c != "path"]

    def side(name: str) -> DataFrame:
        return facts.select(F.col("path").alias(f"{name}_path"), F.struct(*known).alias(name))

    joined = entries.join(side("root"), "root_path", "left").join(side("list"), "list_path", "left")
    at_root = F.col("root").isNotNull()
    found = F.coalesce("root", "list")
    return joined.select(
        F.when(at_root, F.col("root_path")).otherwise(F.col("list_path")).alias("path"),
        *(
            F.coalesce(found[c], F.lit(False)).alias(c) if c.startswith("image_") else found[c].alias(c)
            for c in known
        ),
    )


def scan_images(
    spark: SparkSession, spec: DatasetSpec, algorithm: str = "sha256", sizes: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(images, issues): split, path, image_present, image_readable and digest (and with `sizes` width and
    height) over all sources of all splits, one row per split and path; and the issues of splits and sources themselves.  Contents
    are reduced as they are read and go no further."""
    issues: list[tuple] = []
    images = spark.createDataFrame([], f"split string, {_facts(sizes)}")

    def report(severity: str, code: str, message: str, split: str) -> None:
        issues.append((severity, code, message, split, None, None, None))

    for split, sources in spec.sources.items():
        if not sources:
            report("error", "missing_split", settings.NO_SPLIT.format(split=split), split)
        for source in sources:
            status = file_status(spark, source)
            if status == "missing":
                report("error", "missing_split_path", settings.NO_SPLIT_PATH.format(source=source), split)
                continue
            if status == "file" and source.endswith(".txt"):
                found = _scan_list(spark, source, spec.root, algorithm, sizes)
            else:
                found = image_facts(scan_folder(spark, source), algorithm, sizes)
            if found.select("path").isEmpty():
                report("warning", "empty_split", settings.NO_IMAGES.format(source=source), split)
                continue
            images = images.unionByName(found.withColumn("split", F.lit(split)))
    if any(len(sources) > 1 for sources in spec.sources.values()):
        images = images.dropDuplicates(["split", "path"])  # overlapping sources
    return images, issue_rows(spark, issues)


def _scan_list(spark: SparkSession, list_file: str, root: str, algorithm: str, sizes: bool) -> DataFrame:
    """Listed images, wherever they lie.  Images beside listed ones are read too, others are not."""
    entries = read_list_file(spark, list_file, root)
    folders = existing_folders(spark, F.col("root_path"), F.col("list_path"), of=entries)
    if folders:
        facts = image_facts(scan_folder(spark, folders, below=False), algorithm, sizes)
    else:
        facts = spark.createDataFrame([], _facts(sizes))
    return resolve_list(entries, facts)


def scan_labels(spark: SparkSession, images: DataFrame, root: str) -> DataFrame:
    """label_path, content of the `.txt` files in the folders where the labels of `images` belong, as
    bytes: undecodable files must stay visible."""
    folders = existing_folders(spark, label_path(F.col("path"), root), of=images)
    if not folders:
        return spark.createDataFrame([], "label_path string, content binary")
    return scan_files(spark, folders, "*.txt", below=False).withColumnRenamed("path", "label_path")


def scan_named(spark: SparkSession, files: DataFrame, path: str, algorithm: str = "sha256") -> DataFrame:
    """path and digest of the images in the folders that a column of `files` names."""
    folders = existing_folders(spark, F.col(path), of=files)
    if not folders:
        return spark.createDataFrame([], "path string, digest string")
    return image_facts(scan_folder(spark, folders, below=False), algorithm).select("path", "digest")
