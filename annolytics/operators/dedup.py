"""Exact duplicates: choose a winner per content, account for the rest."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.functions.labels import class_counts, rewrite, valid_lines
from annolytics.functions.paths import source_key
from annolytics.taxonomy import Taxonomy


def make_records(
    items: DataFrame, source: Taxonomy, final: Taxonomy, removed: Collection[str]
) -> DataFrame:
    """Items with `lines` to records: final label lines, objects kept and removed.

    path, label_path, split, source_key, digest, output_lines, object_count, class_counts (array in
    final id order), removed_counts (array in the order of `removed`).
    """
    names = set(source.names.values())
    expected = set(final.names.values()) | set(removed)
    if names != expected:
        raise ValueError(
            f"taxonomy mismatch: missing {sorted(expected - names)}, unexpected {sorted(names - expected)}"
        )
    kept = {k: (None if name in removed else final.id_of(name)) for k, name in source.names.items()}
    valid = valid_lines(F.col("lines"))
    origin = [next(k for k, new in kept.items() if new == target) for target in final.ids]
    return items.select(
        "path",
        "label_path",
        "split",
        source_key(F.col("path")).alias("source_key"),
        "digest",
        rewrite(valid, kept).alias("output_lines"),
        class_counts(valid, origin).alias("class_counts"),
        class_counts(valid, [source.id_of(name) for name in removed]).alias("removed_counts"),
    ).withColumn("object_count", F.size("output_lines").cast("bigint"))


def removed_class_totals(records: DataFrame, removed: Collection[str]) -> DataFrame:
    """class_name, annotations of the removed classes over all input records."""
    sums = records.agg(
        *(F.coalesce(F.sum(F.get("removed_counts", i)), F.lit(0)).alias(f"c{i}")
          for i in range(len(removed)))
    )
    rows = [
        F.struct(F.lit(name).alias("class_name"), F.col(f"c{i}").cast("bigint").alias("annotations"))
        for i, name in enumerate(removed)
    ]
    return sums.select(F.inline(F.array(*rows)))


def _groups(records: DataFrame) -> DataFrame:
    """digest, copies, winner, consistent of contents that occur more than once.  The winner is a
    whole row key: one path may be listed in several splits."""
    signature = F.sha2(F.array_join("output_lines", "\n"), 256)
    winner = F.min(F.struct((-F.col("object_count")).alias("o"), "path", "split", "label_path"))
    return (
        records.withColumn("signature", signature)
        .groupBy("digest")
        .agg(
            F.count("*").alias("copies"),
            winner.alias("winner"),
            (F.min("signature") == F.max("signature")).alias("consistent"),
        )
        .where(F.col("copies") > 1)
    )


def duplicate_groups(records: DataFrame) -> DataFrame:
    """digest, copies, kept_image, kept_label, consistent: one row per content that occurs more
    than once.  The kept copy has the most objects, then the smallest path, split and label;
    `consistent` says whether all copies carry the same label lines.  Copies are reduced inside
    each task first, so the size of a group does not matter."""
    return _groups(records).select(
        "digest",
        "copies",
        F.col("winner.path").alias("kept_image"),
        F.col("winner.label_path").alias("kept_label"),
        "consistent",
    )


def with_winner(records: DataFrame) -> DataFrame:
    """Records with `kept_image` (null for unique contents) and `is_kept`."""
    groups = _groups(records).select("digest", F.col("winner").alias("__winner"))
    chosen = F.col("__winner").isNull()
    same = [F.col(f"__winner.{c}").eqNullSafe(F.col(c)) for c in ("path", "split", "label_path")]
    return (
        records.join(groups, "digest", "left")
        .withColumn("kept_image", F.col("__winner.path"))
        .withColumn("is_kept", chosen | (same[0] & same[1] & same[2]))
        .drop("__winner")
    )


def kept_records(judged: DataFrame) -> DataFrame:
    """One record per content."""
    return judged.where("is_kept").drop("is_kept", "kept_image")


def retained_records(judged: DataFrame) -> DataFrame:
    """What goes on: one record per content, and only those with any object left."""
    return kept_records(judged).where(F.col("object_count") > 0)


def removed_files(judged: DataFrame) -> DataFrame:
    """reason, image, label, digest, kept_image of every record that does not go on.  Copies are
    removed first; only winners can count as emptied."""
    reason = F.when(~F.col("is_kept"), "duplicate_sha256").when(
        F.col("object_count") == 0, "empty_after_class_filter"
    )
    return (
        judged.withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select(
            "reason",
            F.col("path").alias("image"),
            F.col("label_path").alias("label"),
            "digest",
            F.when(~F.col("is_kept"), F.col("kept_image")).alias("kept_image"),
        )
    )
