"""Every operator as a query over the driver's tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolytics import settings
from annolytics.functions.detections import detections
from annolytics.functions.naming import class_colour
from annolytics.functions.paths import label_path, media_type, relative_path, source_key
from annolytics.operators import (
    dedup,
    errors,
    experiments,
    freeze,
    inference,
    items,
    matching,
    metrics,
    preview,
    ranking,
    remap,
    sessions,
    split,
    validate,
)
from annolytics.plans.comparison import comparison_views
from annolytics.plans.dataset_jobs import freeze_records
from annolytics.session import cut_lineage, fresh_folder
from annolytics.streaming import sessions as streams
from annolytics.workloads import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FINAL_N = len(settings.FINAL_CLASSES)
MAPPING = remap.id_mapping(
    fx.SOURCE, fx.TARGET, settings.CLASS_SYNONYMS, settings.REMOVED_SOURCE_CLASSES
)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def joined_items(spark: SparkSession, sf: str) -> DataFrame:
    return items.annotated_items(fx.images(spark, sf), fx.label_files(spark, sf), fx.ROOT)


def dirty_items(spark: SparkSession, sf: str) -> DataFrame:
    return items.with_lines(joined_items(spark, sf), fx.SOURCE)


def all_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Issues read the items twice, so contents are hashed once and the compact rows written."""
    found = cut_lineage(joined_items(spark, sf))
    return validate.all_issues(items.with_lines(found, fx.SOURCE))


def digests(spark: SparkSession, sf: str) -> DataFrame:
    return cut_lineage(joined_items(spark, sf).select("digest", "split", "path"))


def clean_records(spark: SparkSession, sf: str) -> DataFrame:
    joined = items.annotated_items(fx.clean_images(spark, sf), fx.clean_label_files(spark, sf), fx.ROOT)
    strict = remap.reject_bad_lines(items.with_lines(joined, fx.TARGET))
    return cut_lineage(
        dedup.make_records(strict, fx.TARGET, fx.FINAL, settings.REMOVED_FINAL_CLASSES)
    )


def retained(spark: SparkSession, sf: str) -> DataFrame:
    return cut_lineage(dedup.retained_records(dedup.with_winner(clean_records(spark, sf))))


def grouped(records: DataFrame) -> DataFrame:
    """The groups are read several times from here on, so they are written once."""
    groups = cut_lineage(split.source_groups(records, FINAL_N))
    return split.assign_splits(groups, FINAL_N)


def assigned(spark: SparkSession, sf: str) -> DataFrame:
    return grouped(retained(spark, sf))


def final_items(spark: SparkSession, sf: str) -> DataFrame:
    records = retained(spark, sf)
    return cut_lineage(freeze.final_items(records, grouped(records)))


def sums(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_sums(assigned(spark, sf), FINAL_N, settings.OUTPUT_SPLITS)


def joined_text(array: str):
    return F.array_join(F.transform(F.col(array), lambda n: n.cast("string")), ",")


# --- validation -----------------------------------------------------------------------------------


@query
def annotation_counts_by_split_class(spark, sf):
    counts = validate.split_counts(dirty_items(spark, sf), fx.SOURCE)
    return validate.class_grid(counts, fx.SOURCE, fx.SPLITS)


@query
def validation_split_counts(spark, sf):
    counts = validate.split_counts(dirty_items(spark, sf), fx.SOURCE)
    return counts.drop("annotations_by_class", "images_by_class")


@query
def validation_issues(spark, sf):
    return all_issues(spark, sf).withColumn("line", F.col("line").cast("bigint"))


@query
def validation_issue_counts(spark, sf):
    return validate.issue_counts(all_issues(spark, sf))


@query
def validation_verdict(spark, sf):
    return validate.dataset_is_valid(all_issues(spark, sf))


@query
def validation_rollup(spark, sf):
    return validate.class_totals(annotation_counts_by_split_class(spark, sf))


@query
def class_shares(spark, sf):
    return validate.class_shares(annotation_counts_by_split_class(spark, sf))


@query
def duplicate_contents(spark, sf):
    found = validate.duplicate_contents(dirty_items(spark, sf))
    return found.withColumn("splits", F.array_join("splits", ","))


@query
def duplicate_members(spark, sf):
    return validate.duplicate_members(digests(spark, sf))


@query
def valid_annotations(spark, sf):
    rows = items.annotations(dirty_items(spark, sf))
    return rows.select("path", F.col("line_no").cast("bigint").alias("line_no"), "class_id", *"xywh")


# --- paths and names ------------------------------------------------------------------------------


@query
def label_paths(spark, sf):
    paths = fx.images(spark, sf).select("path")
    other = F.regexp_replace("path", "/images/", "/pictures/")
    return paths.select(
        "path",
        label_path(F.col("path"), fx.ROOT).alias("label_path"),
        label_path(other, fx.ROOT).alias("mirrored_path"),
    )


@query
def source_keys(spark, sf):
    return fx.images(spark, sf).select("path", source_key(F.col("path")).alias("source_key"))


@query
def relative_paths(spark, sf):
    sources = ["/ds/train/images", "/ds/val"]
    return fx.images(spark, sf).select(
        "path", relative_path(F.col("path"), sources).alias("relative_path")
    )


@query
def media_routes(spark, sf):
    suffix = "CASE o_orderstatus WHEN 'F' THEN '.MP4' WHEN 'O' THEN '.jpeg' ELSE '.txt' END"
    names = fx.table(spark, sf, "orders").select(F.expr(f"'clip_' || o_orderkey || {suffix}").alias("n"))
    return (
        names.groupBy(media_type(F.col("n")).alias("media_type")).agg(F.count("*").alias("files"))
    )


@query
def class_colors(spark, sf):
    found = items.annotations(dirty_items(spark, sf)).groupBy("class_id").agg(F.count("*").alias("objects"))
    return found.withColumn("color", class_colour(F.col("class_id")))


# --- taxonomy -------------------------------------------------------------------------------------


@query
def taxonomy_diff(spark, sf):
    lines = dirty_items(spark, sf).select(F.explode("lines").alias("line"))
    token = F.get("line.fields", 0)
    names = lines.select(
        F.coalesce(fx.SOURCE.name_of(F.col("line.class_id")), token).alias("name")
    )
    rules = [*settings.CLASS_SYNONYMS, *settings.REMOVED_SOURCE_CLASSES, "face shield"]
    return remap.taxonomy_gaps(names, spark.createDataFrame([(r,) for r in rules], "name string"))


def remapped(spark, sf):
    return remap.remap_labels(dirty_items(spark, sf), MAPPING, fx.SOURCE, fx.TARGET)


def readable(spark, sf):
    return remapped(spark, sf).where(F.col("label_text").isNotNull())


@query
def remap_labels(spark, sf):
    outputs = remap.output_paths(
        readable(spark, sf), [f"/ds/{s}/images" for s in fx.SPLITS], settings.PUBLISHED_SPLIT_NAMES
    )
    return outputs.select("path", "output_image", "output_label", "new_text")


@query
def remap_counts(spark, sf):
    counts = remap.remap_accounting(readable(spark, sf), fx.SOURCE, fx.TARGET)
    return counts.withColumns({c: joined_text(c) for c in ("old_counts", "new_counts")})


@query
def remap_class_counts(spark, sf):
    counts = remap.remap_accounting(readable(spark, sf), fx.SOURCE, fx.TARGET)
    return remap.class_count_rows(counts, "new_counts", fx.TARGET)


@query
def emptied_images(spark, sf):
    return remap.emptied_images(readable(spark, sf))


# --- duplicates, splits, freeze -------------------------------------------------------------------


@query
def duplicate_consistency(spark, sf):
    return dedup.duplicate_groups(clean_records(spark, sf))


@query
def dedup_kept(spark, sf):
    kept = dedup.kept_records(dedup.with_winner(clean_records(spark, sf)))
    return kept.select("path", "digest", "object_count", joined_text("class_counts").alias("class_counts"))


@query
def removed_files(spark, sf):
    return dedup.removed_files(dedup.with_winner(clean_records(spark, sf)))


@query
def removed_class_totals(spark, sf):
    return dedup.removed_class_totals(clean_records(spark, sf), settings.REMOVED_FINAL_CLASSES)


@query
def source_groups(spark, sf):
    groups = split.source_groups(retained(spark, sf), FINAL_N)
    return groups.withColumns({c: joined_text(c) for c in ("class_counts", "class_image_counts")})


@query
def split_assignment(spark, sf):
    return assigned(spark, sf).select(
        "source_key", "size", F.col("stratum").cast("bigint").alias("stratum"), "split"
    )


@query
def split_stats(spark, sf):
    stats = freeze.split_statistics(final_items(spark, sf), FINAL_N)
    return stats.withColumns({c: joined_text(c) for c in ("class_counts", "class_image_counts")})


@query
def split_ratios(spark, sf):
    shares, _ = split.split_shares(sums(spark, sf), settings.SPLIT_RATIOS, fx.FINAL)
    return shares.withColumns(
        {c: F.round(c, 9) for c in ("actual_ratio", "target_ratio", "ratio_deviation")}
    )


@query
def split_class_shares(spark, sf):
    _, per_class = split.split_shares(sums(spark, sf), settings.SPLIT_RATIOS, fx.FINAL)
    return per_class.withColumn("share", F.round("share", 9))


@query
def split_objective(spark, sf):
    return split.split_objective(sums(spark, sf), settings.SPLIT_RATIOS, FINAL_N).select(
        F.round("objective", 9).alias("objective")
    )


@query
def coverage_gaps(spark, sf):
    return split.coverage_gaps(sums(spark, sf), fx.FINAL, settings.FINAL_CLASSES)


@query
def split_best_moves(spark, sf):
    """The first round of the refinement, group by group."""
    moves = split.best_moves(assigned(spark, sf), FINAL_N)
    return moves.withColumn("delta", F.round("delta", 9))


@query
def split_refinement_check(spark, sf):
    """What a refinement may not change or make worse."""
    before = cut_lineage(assigned(spark, sf))
    after = cut_lineage(split.refine_splits(before, FINAL_N))

    def objective(groups):
        totals = split.split_sums(groups, FINAL_N, settings.OUTPUT_SPLITS)
        return split.split_objective(totals, settings.SPLIT_RATIOS, FINAL_N).scalar()

    return after.agg(F.count("*").alias("groups"), F.sum("size").cast("bigint").alias("images")).withColumn(
        "not_worse", objective(after) <= objective(before)
    )


@query
def split_refined(spark, sf):
    return split.refine_splits(assigned(spark, sf), FINAL_N).select("source_key", "size", "split")


def uncovered(spark, sf):
    """Groups of which all with a violation were put into the training split."""
    places = [settings.FINAL_CLASSES.index(name) for name in settings.VIOLATION_CLASSES]
    violating = F.greatest(*(F.get("class_image_counts", i) for i in places)) > 0
    groups = assigned(spark, sf)
    return cut_lineage(groups.withColumn("split", F.when(violating, "train").otherwise(F.col("split"))))


def covered(groups: DataFrame) -> DataFrame:
    return split.repair_coverage(groups, fx.FINAL, settings.VIOLATION_CLASSES)


@query
def coverage_gaps_forced(spark, sf):
    totals = split.split_sums(uncovered(spark, sf), FINAL_N, settings.OUTPUT_SPLITS)
    return split.coverage_gaps(totals, fx.FINAL, settings.VIOLATION_CLASSES)


@query
def coverage_moves(spark, sf):
    """Groups that the repair moves, from and to."""
    before = uncovered(spark, sf)
    after = covered(before).select("source_key", F.col("split").alias("target"))
    return before.select("source_key", "split").join(after, "source_key").where("split <> target")


@query
def coverage_repaired(spark, sf):
    """Images of every required class in every split after the repair."""
    totals = split.split_sums(covered(uncovered(spark, sf)), FINAL_N, settings.OUTPUT_SPLITS)
    _, per_class = split.split_shares(totals, settings.SPLIT_RATIOS, fx.FINAL)
    wanted = F.col("class_name").isin(*settings.VIOLATION_CLASSES)
    return per_class.where(wanted).select("split", "class_name", "images")


def frozen(spark, sf):
    """The tables of the freeze job: refined, guarded and fingerprinted."""
    return freeze_records(clean_records(spark, sf), fx.FINAL, settings.REMOVED_FINAL_CLASSES)


@query
def frozen_manifest(spark, sf):
    return freeze.manifest(frozen(spark, sf)["manifest"])


@query
def frozen_digest(spark, sf):
    return frozen(spark, sf)["fingerprint"]


@query
def frozen_split_stats(spark, sf):
    stats = frozen(spark, sf)["split_stats"]
    return stats.withColumns({c: joined_text(c) for c in ("class_counts", "class_image_counts")})


def original_items(spark, sf):
    return clean_records(spark, sf).select(
        "split",
        F.col("path").alias("image"),
        F.col("label_path").alias("label"),
        F.col("digest").alias("image_sha256"),
        "source_key",
    )


@query
def leakage_audit(spark, sf):
    return freeze.leakage_audit(original_items(spark, sf))


@query
def source_leakage(spark, sf):
    return freeze.source_leakage(original_items(spark, sf)).withColumn(
        "splits", F.array_join("splits", ",")
    )


@query
def leakage_audit_frozen(spark, sf):
    return freeze.leakage_audit(final_items(spark, sf))


@query
def pairing_audit(spark, sf):
    labels = fx.label_files(spark, sf).select(
        F.split_part("label_path", F.lit("/"), F.lit(3)).alias("split"), F.col("label_path").alias("label")
    )
    present = fx.images(spark, sf).where(F.col("content").isNotNull())
    return freeze.pairing_audit(present.select("split", F.col("path").alias("image")), labels)


@query
def name_collisions(spark, sf):
    variants = fx.clean_images(spark, sf).withColumn(
        "path", F.regexp_replace("path", r"(\.rf\.[0-9a-f]+)?_[0-9]+\.jpg$", ".jpg")
    )
    return remap.name_collisions(variants, "split", "path")


@query
def freeze_manifest(spark, sf):
    return freeze.manifest(final_items(spark, sf))


@query
def dataset_digest(spark, sf):
    return freeze.dataset_digest(freeze.manifest(final_items(spark, sf)), freeze.EXACT)


@query
def dataset_tree_digest(spark, sf):
    return freeze.tree_digest(freeze.manifest(final_items(spark, sf)))


def status_of_altered(spark, sf):
    """The manifest against files of which some were changed or lost after the freeze."""
    final = final_items(spark, sf)
    number = F.regexp_extract("image", r"_([0-9]+)[.]jpg$", 1).cast("bigint")
    files = final.withColumn("number", number)
    images = files.select(
        F.when(F.col("number") % 50 == 7, F.concat("image", F.lit(".moved"))).otherwise(F.col("image")).alias("path"),
        F.when(F.col("number") % 50 == 8, F.sha2("image_sha256", 256)).otherwise(F.col("image_sha256")).alias("sha256"),
    )
    labels = files.select(
        F.col("label").alias("path"),
        F.when(F.col("number") % 50 == 9, F.sha2("label_sha256", 256)).otherwise(F.col("label_sha256")).alias("sha256"),
    )
    return freeze.manifest_status(freeze.manifest(final), images, labels)


@query
def manifest_status(spark, sf):
    return status_of_altered(spark, sf).select("image", "label", "status")


@query
def manifest_changes(spark, sf):
    """Files that differ after some were renamed, lost or altered, found by descending the hash trees."""
    rows = freeze.manifest(final_items(spark, sf))
    number = F.regexp_extract("image", r"_([0-9]+)[.]jpg$", 1).cast("bigint") % 50
    altered = rows.withColumn("number", number).where("number <> 7").select(
        F.when(F.col("number") == 6, F.concat("image", F.lit(".moved"))).otherwise(F.col("image")).alias("image"),
        "label",
        F.when(F.col("number").isin(8, 10), F.sha2("image_sha256", 256)).otherwise(F.col("image_sha256")).alias("image_sha256"),
        F.when(F.col("number").isin(9, 10), F.sha2("label_sha256", 256)).otherwise(F.col("label_sha256")).alias("label_sha256"),
    )
    return freeze.manifest_changes(
        freeze.tree_leaves(rows), freeze.tree_nodes(rows), freeze.tree_leaves(altered), freeze.tree_nodes(altered)
    )


@query
def manifest_verification(spark, sf):
    """Bytes and texts are hashed anew: as they were frozen, and with some of them altered."""
    final = final_items(spark, sf)
    rows = freeze.manifest(final)
    recorded = cut_lineage(freeze.dataset_digest(rows))
    contents = fx.clean_images(spark, sf).select(F.col("path").alias("source_image"), "content")
    files = cut_lineage(
        final.join(contents, "source_image").select(
            "image",
            "label",
            F.sha2("content", 256).alias("image_sha256"),
            F.sha2("label_text", 256).alias("label_sha256"),
            (F.regexp_extract("image", r"_([0-9]+)[.]jpg$", 1).cast("bigint") % 50).alias("number"),
        )
    )
    altered = F.sha2(F.lit("altered"), 256)

    def verified(state, image_sha256, label_sha256):
        images = files.select(F.col("image").alias("path"), image_sha256.alias("sha256"))
        labels = files.select(F.col("label").alias("path"), label_sha256.alias("sha256"))
        status = freeze.manifest_status(rows, images, labels)
        expected = recorded.select("dataset_sha256").scalar()
        return freeze.verify_manifest(status, recorded, expected).withColumn("state", F.lit(state))

    image, label = F.col("image_sha256"), F.col("label_sha256")
    return verified("as frozen", image, label).unionByName(
        verified(
            "altered",
            F.when(F.col("number") == 8, altered).otherwise(image),
            F.when(F.col("number") == 9, altered).otherwise(label),
        )
    )


@query
def freeze_summary(spark, sf):
    records = clean_records(spark, sf)
    judged = cut_lineage(dedup.with_winner(records))
    kept = dedup.retained_records(judged)
    return freeze.freeze_counts(
        records,
        dedup.duplicate_groups(records),
        judged,
        freeze.final_items(kept, grouped(kept)),
        settings.REMOVED_FINAL_CLASSES,
    )


# --- matching, errors, metrics --------------------------------------------------------------------


def active(spark, sf):
    return fx.predictions(spark, sf).where(F.col("conf") >= settings.ACTIVE_CONFIDENCE)


def matches(spark, sf):
    return matching.greedy_match(matching.match_candidates(fx.truth(spark, sf), active(spark, sf)))


@query
def iou_candidates(spark, sf):
    return matching.match_candidates(fx.truth(spark, sf), fx.predictions(spark, sf))


@query
def greedy_matches(spark, sf):
    return matches(spark, sf)


@query
def match_components(spark, sf):
    found = matching.match_candidates(fx.truth(spark, sf), fx.predictions(spark, sf), settings.OCCLUSION_IOU)
    return matching.match_components(found)


@query
def missed_and_extra(spark, sf):
    both = matching.missed_and_extra(fx.truth(spark, sf), active(spark, sf), matches(spark, sf))
    return both.select("side", "image_id", "class_id", "idx")


@query
def class_confusions(spark, sf):
    found, truth, predictions = matches(spark, sf), fx.truth(spark, sf), active(spark, sf)
    return matching.class_confusions(
        matching.unmatched(truth, found, "gi"),
        matching.unmatched(predictions, found, "pi"),
        counted=(truth, predictions),
    )


@query
def overlapping_truth(spark, sf):
    boxes = fx.truth(spark, sf)
    return matching.overlapping_truth(boxes, boxes)


def errors_by_image(spark, sf):
    return errors.image_errors(fx.truth(spark, sf), fx.predictions(spark, sf))


@query
def image_errors(spark, sf):
    return errors_by_image(spark, sf)


@query
def error_categories(spark, sf):
    return errors.error_categories(errors_by_image(spark, sf))


@query
def error_examples_topk(spark, sf):
    return errors.error_examples(errors_by_image(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


def boxes_of_labels(spark, sf):
    """Truth from label lines and the sizes in image headers, and predictions near it."""
    sized = fx.sized_images(spark, sf)
    found = items.with_lines(items.annotated_items(sized, fx.clean_label_files(spark, sf), fx.ROOT, sizes=True), fx.TARGET)
    boxes = cut_lineage(items.truth_boxes(found, "image_id"))
    return boxes, fx.project(boxes, fx.LABEL_PREDICTIONS)


@query
def image_sizes(spark, sf):
    facts = items.image_facts(fx.sized_images(spark, sf), sizes=True)
    return facts.select("path", "width", "height")


@query
def truth_from_labels(spark, sf):
    boxes, _ = boxes_of_labels(spark, sf)
    return boxes


@query
def error_categories_from_labels(spark, sf):
    return errors.error_categories(errors.image_errors(*boxes_of_labels(spark, sf)))


def matched(spark, sf):
    return metrics.matched_predictions(fx.truth(spark, sf), fx.predictions(spark, sf))


@query
def prediction_count(spark, sf):
    return metrics.prediction_count(fx.predictions(spark, sf))


@query
def pr_curve(spark, sf):
    return metrics.precision_recall_curve(matched(spark, sf), fx.truth(spark, sf))


@query
def average_precision(spark, sf):
    curve = metrics.precision_recall_curve(matched(spark, sf), fx.truth(spark, sf))
    return metrics.average_precision(curve).withColumn("ap", F.round("ap", 9))


def class_metrics(spark, sf):
    return metrics.detection_metrics(matched(spark, sf), fx.truth(spark, sf), fx.TARGET)


@query
def detection_metrics(spark, sf):
    return class_metrics(spark, sf).withColumns(
        {c: F.round(c, 9) for c in ("precision", "recall", "ap50", "ap50_95")}
    )


@query
def mean_metrics(spark, sf):
    found = metrics.mean_metrics(class_metrics(spark, sf))
    return found.select(*(F.round(c, 9).alias(c) for c in found.columns))


@query
def latency_summary(spark, sf):
    log = fx.table(spark, sf, "events")
    found = metrics.latency_summary(log, ["event_type"], "value")
    return found.withColumns({c: F.round(c, 9) for c in ("mean_ms", "p50_ms", "p95_ms")})


# --- experiments ----------------------------------------------------------------------------------


def summary(spark, sf):
    return experiments.run_summary(
        fx.runs(spark, sf),
        fx.resumes(spark, sf),
        fx.epochs(spark, sf),
        fx.test_metrics(spark, sf),
        fx.performance(spark, sf),
    )


def views(spark, sf):
    return comparison_views(cut_lineage(summary(spark, sf)), fx.per_class(spark, sf))


@query
def best_epochs(spark, sf):
    return experiments.best_epochs(fx.epochs(spark, sf))


@query
def run_summary(spark, sf):
    return summary(spark, sf).select(
        "run", "label", "model", "status", "resumed", "stopped_early", "best_epoch", "logged_epochs",
        "completed_epochs", "map50_95", "test_map50_95", "mean_latency_ms",
        F.round("duration_seconds", 6).alias("duration_seconds"),
    )


@query
def model_selection(spark, sf):
    return experiments.comparison_context(summary(spark, sf))


@query
def attempts(spark, sf):
    return experiments.number_attempts(fx.attempts(spark, sf)).select(
        "run", "attempt_id", "attempt", "outcome"
    )


@query
def ranked_experiments(spark, sf):
    return views(spark, sf)["experiments"]


@query
def per_class_long(spark, sf):
    return views(spark, sf)["per_class"].withColumn("class_order", F.col("class_order").cast("bigint"))


@query
def comparison_headline(spark, sf):
    return views(spark, sf)["headline"]


@query
def first_images(spark, sf):
    test = fx.images(spark, sf).where("split = 'test'").select("path")
    return ranking.first_rows(test, ["path"], 100)


# --- sessions -------------------------------------------------------------------------------------


def _flat(found: DataFrame) -> DataFrame:
    def text(column: str):
        return F.array_join(
            F.transform(F.map_entries(column), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))),
            ",",
        )

    return found.withColumns({c: text(c) for c in ("class_counts", "violation_counts")})


@query
def session_summary(spark, sf):
    return _flat(sessions.session_summary(fx.frames(spark, sf), fx.FINAL))


@query
def violation_frames(spark, sf):
    found = sessions.violation_frames(fx.frames(spark, sf), fx.session_meta(spark, sf))
    return found.select("session_id", "frame", "time_seconds", _violation_text())


def _violation_text():
    return F.array_join(
        F.transform("violations", lambda d: F.concat_ws(":", d["class_name"], d["confidence"].cast("string"))), ","
    ).alias("violations")


@query
def session_limits(spark, sf):
    return sessions.session_limits(fx.frames(spark, sf), fx.session_meta(spark, sf))


@query
def violation_rate_hourly(spark, sf):
    return _as_local(sessions.violation_rates(fx.frames(spark, sf)))


def _as_local(rates: DataFrame) -> DataFrame:
    return rates.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query
def detection_normalisation(spark, sf):
    box = F.array(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    raw = fx.predictions(spark, sf).select(
        "image_id", "idx",
        detections(
            F.array(F.col("class_id").cast("double")), F.array(F.col("conf") / 7), F.array(box), fx.FINAL
        ).alias("d"),
    )
    return raw.select("image_id", "idx", F.inline("d")).select(
        "image_id", "idx", "class_id", "class_name", "confidence",
        *(F.get("xyxy", i).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))),
    )


def _streamed(
    spark: SparkSession, sf: str, start: Callable[[DataFrame], DataFrame], mode: str = "update"
) -> DataFrame:
    """All revisions that `start(frames)` writes while the events arrive in several parts, each read
    by a query started anew from the same checkpoint."""
    folder = fresh_folder(spark, "stream")
    for number, part in enumerate(fx.arrivals(spark, sf)):
        part.write.parquet(f"{folder}/in/batch={number}")
        stream = start(fx.frame_stream(spark, sf, f"{folder}/in"))
        streams.write_revisions(stream, f"{folder}/rows", f"{folder}/state", mode).awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


@query
def session_summary_stream(spark, sf):
    revisions = _streamed(spark, sf, lambda frames: streams.running_summary(frames, fx.FINAL, gap=None))
    return _flat(streams.latest_rows(revisions, ["session_id"]))


SESSION_GAP, SESSION_LATENESS = timedelta(hours=18), "1 hour"


@query
def ended_sessions_stream(spark, sf):
    """Every session that ended before the last watermark, as emitted, once."""
    gap = f"{SESSION_GAP // timedelta(hours=1)} hours"

    def start(frames):
        return streams.ended_sessions(frames, fx.FINAL, gap, SESSION_LATENESS)

    found = _streamed(spark, sf, start, "append").select(
        "session_id", F.col("started").cast("timestamp_ntz").alias("started"),
        F.col("ended").cast("timestamp_ntz").alias("ended"), "status", "frames_processed", "frames_with_violations",
        "violation_detection_events", "max_violations_in_frame", "class_counts", "violation_counts",
    )
    return _flat(found)


@query
def ended_violations_stream(spark, sf):
    def start(frames):
        return streams.ended_violations(frames, 5, SESSION_GAP, SESSION_LATENESS, together=64)

    found = _streamed(spark, sf, start, "append").withColumn(
        "violations", F.from_json("violations", "array<struct<class_id:long,class_name:string,confidence:double>>")
    )
    return found.select("session_id", F.col("ended").cast("timestamp_ntz").alias("ended"), "frame", _violation_text())


@query
def violation_rate_stream(spark, sf):
    revisions = _streamed(spark, sf, streams.running_rates)
    return _as_local(streams.latest_rows(revisions, ["window_start", "class_name"]))


@query
def violation_frames_stream(spark, sf):
    revisions = _streamed(spark, sf, streams.first_violations)
    return streams.latest_groups(revisions, ["session_id"]).select(
        "session_id", "frame",
        F.from_json("violations", "array<struct<class_id:long,class_name:string,confidence:double>>").alias("violations"),
    ).select("session_id", "frame", _violation_text())


# --- preview and inference ------------------------------------------------------------------------

SAMPLES = 8


def candidates(spark, sf):
    return cut_lineage(preview.preview_candidates(dirty_items(spark, sf), fx.SOURCE))


@query
def preview_sample(spark, sf):
    return preview.sample_preview(candidates(spark, sf), SAMPLES).select(
        "split", "path", F.col("rank").cast("bigint").alias("rank"), "objects", "output_name"
    )


@query
def preview_summary(spark, sf):
    found = candidates(spark, sf)
    return preview.preview_summary(found, preview.sample_preview(found, SAMPLES), SAMPLES, fx.SPLITS)


@query
def preview_distribution(spark, sf):
    sample = preview.sample_preview(candidates(spark, sf), SAMPLES)
    return preview.preview_distribution(sample, fx.SOURCE)


@query
def pixel_boxes(spark, sf):
    boxes = preview.pixel_boxes(items.annotations(dirty_items(spark, sf)))
    return boxes.select("path", F.col("line_no").cast("bigint").alias("line_no"), "x1", "y1", "x2", "y2")


@query
def batched_inference_stub(spark, sf):
    def make_predict():
        def predict(batch):
            return batch.assign(
                conf=(batch["image_id"] * 37 % 101) / 101.0, class_id=batch["image_id"] % 7
            )[["image_id", "class_id", "conf"]]

        return predict

    rows = fx.images(spark, sf).select("image_id")
    return inference.batched_inference(rows, make_predict, 16, "image_id long, class_id long, conf double")
