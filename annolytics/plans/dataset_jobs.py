"""Whole jobs over a dataset: audit it, remap its classes, freeze it, verify it."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolytics import settings
from annolytics.functions.content import digest
from annolytics.operators import dedup, errors, freeze, remap, split, validate
from annolytics.operators.items import join_labels, truth_boxes, with_lines
from annolytics.session import cut_lineage
from annolytics.sources.files import copied_files, text_files, write_files
from annolytics.sources.images import scan_images, scan_labels, scan_named
from annolytics.sources.publish import check_target, publish, published, read_published, write_reports
from annolytics.sources.spec import DatasetSpec, issue_rows, read_spec, spec_text
from annolytics.sources.storage import create_file, file_status
from annolytics.taxonomy import Taxonomy


def load_items(
    spark: SparkSession, path: str, algorithm: str = "sha256", sizes: bool = False
) -> tuple[DatasetSpec, DataFrame, DataFrame]:
    """(specification, items, issues of sources) of a dataset: a specification file, or the target folder
    of `remap_dataset`, whose newest published version is read (without sizes of images)."""
    if file_status(spark, path) == "folder":
        if sizes:
            raise ValueError("a remapped dataset records no image sizes: export it and read its specification")
        return _remapped_items(spark, path, algorithm)
    spec = read_spec(spark, path)
    images, issues = scan_images(spark, spec, algorithm, sizes)
    items = join_labels(images, scan_labels(spark, images, spec.root), spec.root)
    return spec, items, issues


def _remapped_items(spark: SparkSession, target: str, algorithm: str) -> tuple[DatasetSpec, DataFrame, DataFrame]:
    """Image facts are those that the remap recorded; label texts are the new ones."""
    if algorithm != "sha256":
        raise ValueError("a remapped dataset records sha256 digests")
    folder = published(spark, target)
    taxonomy = _read_classes(spark, folder)
    inner = {name: split for split, name in settings.PUBLISHED_SPLIT_NAMES.items()}
    sources = {split: (f"{folder}/labels/split={name}",) for name, split in inner.items()}
    labels = spark.read.schema(_REMAPPED).parquet(f"{folder}/labels")
    split_name = F.create_map(*(F.lit(p) for pair in inner.items() for p in pair))[F.col("split")]
    items = labels.select(
        split_name.alias("split"),
        "path",
        F.concat(F.lit(folder + "/"), "output_label").alias("label_path"),
        F.lit(True).alias("image_present"),
        "image_readable",
        "digest",
        F.lit(True).alias("label_present"),
        "label_text",
    )
    return DatasetSpec(folder, target, taxonomy, sources), items, issue_rows(spark, [])


_REMAPPED = (
    "split string, path string, image_readable boolean, digest string, output_image string, "
    "output_label string, label_text string"
)


def validate_dataset(
    spark: SparkSession, path: str, algorithm: str = "sha256", report: str | None = None
) -> dict[str, DataFrame]:
    """Tables of the audit: issues, issue_counts, verdict, splits, classes, totals, duplicates.  With `report`
    the counts and issues are written there too."""
    started = datetime.now(UTC)
    spec, items, source_issues = load_items(spark, path, algorithm)
    # All tables below start from these compact rows: image bytes are read once.
    items = with_lines(cut_lineage(items), spec.taxonomy)
    issues = validate.all_issues(items, source_issues)
    counts = validate.split_counts(items, spec.taxonomy)
    grid = validate.class_grid(counts, spec.taxonomy, list(spec.sources))
    tables = {
        "issues": issues,
        "issue_counts": validate.issue_counts(issues),
        "verdict": validate.dataset_is_valid(issues),
        "splits": counts,
        "classes": grid,
        "totals": validate.class_totals(grid),
        "duplicates": validate.duplicate_members(items),
    }
    if report is not None:
        flat = ("issues", "issue_counts", "verdict", "classes", "totals", "duplicates")
        write_reports({name: tables[name] for name in flat}, report, started)
    return tables


def analyse_errors(
    spark: SparkSession,
    path: str,
    predictions: DataFrame,
    split_name: str = "test",
    active: float = settings.ACTIVE_CONFIDENCE,
    low: float = settings.LOW_CONFIDENCE,
    report: str | None = None,
) -> dict[str, DataFrame]:
    """What goes wrong on one split of a dataset, from its label files, the sizes in its images' headers and
    `predictions`: path, idx, class_id, x1, y1, x2, y2 (pixels) and conf.

    Tables: images (events per image and category), categories, examples.  A bad label line or an annotated
    image whose size its header does not tell stops the job.
    """
    started = datetime.now(UTC)
    spec, items, issues = load_items(spark, path, sizes=True)
    _require_sources(issues)
    chosen = _require_images(items.where(F.col("split") == split_name))
    truth = cut_lineage(truth_boxes(remap.reject_bad_lines(with_lines(chosen, spec.taxonomy))))
    found = cut_lineage(errors.image_errors(truth, predictions.withColumnRenamed("path", "image_id"), active, low))
    tables = {
        "images": found,
        "categories": errors.error_categories(found),
        "examples": errors.error_examples(found),
    }
    if report is not None:
        write_reports(tables, report, started)
    return tables


def remap_dataset(
    spark: SparkSession,
    spec_path: str,
    target: str,
    rules: Mapping[str, str] = settings.CLASS_SYNONYMS,
    removed: Collection[str] = settings.REMOVED_SOURCE_CLASSES,
    classes: Sequence[str] = settings.TARGET_CLASSES,
) -> str:
    """Write a copy of the dataset under another taxonomy: tables labels, accounting, emptied,
    classes.  Any invalid line stops the job; the source is only read."""
    spec, items, issues = load_items(spark, spec_path)
    check_target(spark, spec.require_all_splits().root, target, overwrite=False)
    taxonomy = Taxonomy.of(classes)
    mapping = remap.id_mapping(spec.taxonomy, taxonomy, rules, removed)
    _require_sources(issues)
    items = remap.reject_bad_lines(with_lines(_require_images(items), spec.taxonomy))
    mapped = remap.remap_labels(items, mapping, spec.taxonomy, taxonomy)
    sources = [source for found in spec.sources.values() for source in found]
    outputs = remap.output_paths(mapped, sources, settings.PUBLISHED_SPLIT_NAMES)
    written = outputs.select(
        F.col("output_split").alias("split"),
        "path",
        "image_readable",
        "digest",
        "output_image",
        "output_label",
        F.col("new_text").alias("label_text"),
        "old_counts",
        "new_counts",
        "new_lines",
    )

    def audit(read) -> None:
        clash = read("labels").groupBy("output_image").count().where("count > 1").limit(1).collect()
        if clash:
            raise ValueError(f"several images map to one output path: {clash[0]['output_image']}")

    written = cut_lineage(written)
    return publish(
        {
            "labels": written.drop("old_counts", "new_counts", "new_lines"),
            "accounting": remap.remap_accounting(written, spec.taxonomy, taxonomy),
            "emptied": remap.emptied_images(written),
            "classes": taxonomy.table(spark),
        },
        target,
        audit,
        {"labels": "split"},
    )


def freeze_dataset(
    spark: SparkSession,
    spec_path: str,
    target: str,
    seed: int = 42,
    overwrite: bool = False,
    ratios: Mapping[str, float] = settings.SPLIT_RATIOS,
    classes: Sequence[str] = settings.FINAL_CLASSES,
    removed: Sequence[str] = settings.REMOVED_FINAL_CLASSES,
    required: Sequence[str] = settings.VIOLATION_CLASSES,
) -> str:
    """Deduplicate, drop emptied items, split by source, audit, fingerprint and publish.  `spec_path`
    may also be the target folder of a remap.  Tables:
    items, manifest, fingerprint, tree, leaves, split_stats, duplicate_groups, removed_files, counts, objective."""
    split.check_ratios(ratios)
    spec, items, issues = load_items(spark, spec_path)
    check_target(spark, spec.require_all_splits().root, target, overwrite)
    final_classes = Taxonomy.of(classes)
    _require_sources(issues)
    items = remap.reject_bad_lines(with_lines(_require_images(items), spec.taxonomy))
    # Parsed once; everything below reads the compact records.
    records = cut_lineage(dedup.make_records(items, spec.taxonomy, final_classes, removed))
    tables = freeze_records(records, final_classes, removed, ratios, seed, required)

    def audit(read) -> None:
        written = read("items")
        freeze.require_distinct_names(written)
        result = freeze.leakage_audit(written).first()
        if not result["passed"]:
            raise RuntimeError(f"the frozen dataset failed its audit: {result.asDict()}")

    return publish(tables, target, audit, {"items": "split"})


def freeze_records(
    records: DataFrame,
    classes: Taxonomy,
    removed: Sequence[str],
    ratios: Mapping[str, float] = settings.SPLIT_RATIOS,
    seed: int = 42,
    required: Sequence[str] = settings.VIOLATION_CLASSES,
) -> dict[str, DataFrame]:
    """The tables of a freeze from parsed records."""
    n = len(classes.ids)
    judged = cut_lineage(dedup.with_winner(records))
    retained = dedup.retained_records(judged)
    groups = cut_lineage(split.source_groups(retained, n))
    assigned = split.assign_splits(groups, n, ratios, seed)
    assigned = split.refine_splits(assigned, n, ratios, seed=seed)
    assigned = split.repair_coverage(assigned, classes, required, ratios)
    sums = split.split_sums(assigned, n, list(ratios))
    split.require_coverage(sums, classes, required)
    final = cut_lineage(freeze.final_items(retained, assigned))
    duplicates = dedup.duplicate_groups(records)
    rows = freeze.manifest(final)
    return {
        "items": final,
        "manifest": rows,
        "fingerprint": freeze.dataset_digest(rows),
        "tree": freeze.tree_nodes(rows),
        "leaves": freeze.tree_leaves(rows),
        "split_stats": freeze.split_statistics(final, n),
        "duplicate_groups": duplicates,
        "removed_files": dedup.removed_files(judged),
        "counts": freeze.freeze_counts(records, duplicates, judged, final, removed),
        "objective": split.split_objective(sums, ratios, n),
        "classes": classes.table(judged.sparkSession),
    }


def verify_frozen(
    spark: SparkSession, target: str, expected_sha256: str, source_images: DataFrame | None = None
) -> DataFrame:
    """Recompute every label digest from the published texts and every image digest from the bytes of
    the source images, and compare with the manifest.  `source_images` (path, content) are read
    from the folders that the manifest names unless given."""
    items = read_published(spark, target, "items")
    manifest = read_published(spark, target, "manifest")
    labels = items.select(
        F.col("label").alias("path"), digest(F.col("label_text")).alias("sha256")
    )
    if source_images is None:
        found = scan_named(spark, items, "source_image")
    else:
        found = source_images.select("path", digest(F.col("content")).alias("digest"))
    found = found.select(F.col("path").alias("source_image"), F.col("digest").alias("sha256"))
    images = items.join(found, "source_image").select(F.col("image").alias("path"), "sha256")
    status = freeze.manifest_status(manifest, images, labels)
    return freeze.verify_manifest(
        status, read_published(spark, target, "fingerprint"), expected_sha256
    )


def compare_frozen(spark: SparkSession, old: str, new: str) -> DataFrame:
    """image, change of the files that differ between two frozen versions, named by their folders as
    `freeze_dataset` returned them.  Equal parts of their hash trees are not read."""
    leaves, nodes = ([spark.read.parquet(f"{folder}/{name}") for folder in (old, new)] for name in ("leaves", "tree"))
    return freeze.manifest_changes(leaves[0], nodes[0], leaves[1], nodes[1])


def export_dataset(spark: SparkSession, target: str, folder: str, name: str = "data.yaml") -> dict[str, int]:
    """The newest published remap or freeze below `target` as a plain folder that other tools read: a copy
    of every image, a label file each, and a specification, which is written last.

    Images are copied from where the dataset was read, and must still have their recorded digests.
    Returns how many files and bytes were written by how many tasks.
    """
    version = published(spark, target)
    check_target(spark, version, folder, overwrite=False)
    if file_status(spark, f"{version}/items") == "folder":
        items = spark.read.parquet(f"{version}/items")
    else:
        labels = spark.read.schema(_REMAPPED).parquet(f"{version}/labels")
        items = labels.select(
            F.col("output_image").alias("image"),
            F.col("output_label").alias("label"),
            F.col("path").alias("source_image"),
            F.col("digest").alias("image_sha256"),
            "label_text",
        )
    written = write_files(
        copied_files(items, "image", "source_image", "image_sha256").unionByName(text_files(items, "label", "label_text")),
        folder,
    )
    folders = {split: f"{output}/images" for split, output in settings.PUBLISHED_SPLIT_NAMES.items()}
    create_file(spark, f"{folder}/{name}", spec_text(_read_classes(spark, version), folders, version))
    return written


def _read_classes(spark: SparkSession, folder: str) -> Taxonomy:
    rows = spark.read.parquet(f"{folder}/classes").orderBy("class_id").collect()
    return Taxonomy.of({row.class_id: row.class_name for row in rows})


def _require_images(items: DataFrame) -> DataFrame:
    missing = F.concat(F.lit("source image does not exist: "), F.col("path"))
    return items.withColumn(
        "image_present",
        F.when(F.col("image_present"), F.lit(True)).otherwise(F.raise_error(missing).cast("boolean")),
    ).where("image_present")


def _require_sources(issues: DataFrame) -> None:
    missing = issues.where("severity = 'error'").limit(1).collect()
    if missing:
        raise FileNotFoundError(missing[0]["message"])
