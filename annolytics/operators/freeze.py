"""Freeze a dataset: what is written, audits of it, and a fingerprint."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolytics import settings
from annolytics.functions.content import digest
from annolytics.functions.labels import file_text
from annolytics.functions.paths import file_name, file_stem
from annolytics.operators.remap import name_collisions
from annolytics.operators.validate import duplicate_contents
from annolytics.session import cut_lineage

EXACT, TREE = "sha256-ordered", "sha256-tree"


def final_items(retained: DataFrame, assignment: DataFrame) -> DataFrame:
    """Retained records with their assigned split and output paths.

    split, image, label, image_sha256, label_text, label_sha256, source_image, source_key,
    class_counts, object_count.  The label digest is that of the text as it is written.
    """
    joined = retained.drop("split").join(assignment.select("source_key", "split"), "source_key")
    text = file_text(F.col("output_lines"))
    return joined.select(
        "split",
        F.concat_ws("/", "split", F.lit("images"), file_name(F.col("path"))).alias("image"),
        F.concat(F.col("split"), F.lit("/labels/"), file_stem(F.col("path")), F.lit(".txt")).alias("label"),
        F.col("digest").alias("image_sha256"),
        text.alias("label_text"),
        digest(text).alias("label_sha256"),
        F.col("path").alias("source_image"),
        "source_key",
        "class_counts",
        "object_count",
    )


def manifest(final: DataFrame) -> DataFrame:
    return final.select(
        "split", "image", "label", "image_sha256", "label_sha256", "source_image", "source_key"
    )


def require_distinct_names(final: DataFrame) -> None:
    clash = name_collisions(final, "split", "image").limit(1).collect()
    if clash:
        raise ValueError(f"output file name collision in {clash[0]['split']}: {clash[0]['name']}")


def split_statistics(final: DataFrame, classes: int) -> DataFrame:
    """split, images, labels, annotations, class_counts, class_image_counts."""
    per_class = [F.get("class_counts", i) for i in range(classes)]
    return final.groupBy("split").agg(
        F.count("image").alias("images"),
        F.count("label").alias("labels"),
        F.sum("object_count").alias("annotations"),
        F.array(*(F.sum(c) for c in per_class)).alias("class_counts"),
        F.array(*(F.count_if(c > 0) for c in per_class)).alias("class_image_counts"),
    )


def source_leakage(final: DataFrame) -> DataFrame:
    """source_key, splits of sources that reach more than one split."""
    return (
        final.groupBy("source_key")
        .agg(F.array_sort(F.collect_set("split")).alias("splits"))
        .where(F.size("splits") > 1)
    )


def leakage_audit(final: DataFrame) -> DataFrame:
    """One row: duplicated contents, those in several splits, sources in several splits, passed."""
    contents = duplicate_contents(final.select("split", F.col("image_sha256").alias("digest"))).agg(
        F.count("*").alias("duplicate_sha256_groups"),
        F.count_if(F.size("splits") > 1).alias("cross_split_sha256_groups"),
    )
    sources = source_leakage(final).agg(F.count("*").alias("n")).scalar()
    audit = contents.withColumn("cross_split_source_groups", sources)
    return audit.withColumn(
        "passed",
        (F.col("duplicate_sha256_groups") == 0)
        & (F.col("cross_split_sha256_groups") == 0)
        & (F.col("cross_split_source_groups") == 0),
    )


def pairing_audit(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images without a label and labels without an image, by split and stem: split, stem, missing.
    `images` has split and image, `labels` has split and label."""
    left = images.select("split", file_stem(F.col("image")).alias("stem"), F.lit(True).alias("i"))
    right = labels.select("split", file_stem(F.col("label")).alias("stem"), F.lit(True).alias("l"))
    missing = F.when(F.col("l").isNull(), "label").when(F.col("i").isNull(), "image")
    return (
        left.join(right, ["split", "stem"], "full_outer")
        .withColumn("missing", missing)
        .where(F.col("missing").isNotNull())
        .select("split", "stem", "missing")
    )


def _record_line() -> Column:
    return F.concat(
        F.concat_ws("|", "image", "image_sha256", "label", "label_sha256"), F.lit("\n")
    )


def _split_rank() -> Column:
    rank = F.when(F.col("split") == settings.OUTPUT_SPLITS[0], 0)
    for position, name in enumerate(settings.OUTPUT_SPLITS[1:], 1):
        rank = rank.when(F.col("split") == name, position)
    return rank.otherwise(len(settings.OUTPUT_SPLITS))


def ordered_digest(rows: DataFrame) -> DataFrame:
    """SHA-256 over the lines `image|sha|label|sha` in split and name order.  A hash over one long
    text is sequential by nature and is made in one row: ask for this form only for manifests that
    fit one."""
    line = F.struct(_split_rank().alias("o"), F.col("image"), _record_line().alias("line"))
    ordered = F.transform(F.array_sort(F.collect_list(line)), lambda row: row["line"])
    return rows.agg(
        F.sha2(F.array_join(ordered, ""), 256).alias("dataset_sha256"),
        F.count("*").alias("files"),
        F.lit(EXACT).alias("hash_scheme"),
    )


_DEPTH = 3  # levels of the tree below its root, of two hex digits each


def _leaf_level(rows: DataFrame, depth: int) -> DataFrame:
    """prefix, node, n of the lowest nodes, which join the leaves with one prefix."""
    leaf = F.sha2(_record_line(), 256)
    level = rows.select(
        leaf.alias("key"),
        F.substring(leaf, 1, 2 * depth).alias("prefix"),
        leaf.alias("node"),
        F.lit(1).cast("bigint").alias("n"),
    )
    return _joined(level)


def _joined(level: DataFrame) -> DataFrame:
    children = F.transform(
        F.array_sort(F.collect_list(F.struct("key", "node"))), lambda child: child["node"]
    )
    return level.groupBy("prefix").agg(F.sha2(F.array_join(children, ""), 256).alias("node"), F.sum("n").alias("n"))


def _parents(level: DataFrame, digits: int) -> DataFrame:
    """The nodes with `digits` digits above a level."""
    return _joined(
        level.select(F.col("prefix").alias("key"), F.substring("prefix", 1, digits).alias("prefix"), "node", "n")
    )


def tree_digest(rows: DataFrame, depth: int = _DEPTH) -> DataFrame:
    """The same evidence as a hash tree of fan-out 256: a leaf per row, nodes by leading hex digits
    of the leaf, each the SHA-256 of its ordered children.  Leaf digests spread evenly, so the
    lowest nodes join about rows / 256**depth leaves each, and the others at most 256 nodes."""
    level = _leaf_level(rows, depth)
    for digits in range(2 * depth - 2, -1, -2):
        level = _parents(level, digits)
    return level.select(
        F.col("node").alias("dataset_sha256"),
        F.col("n").alias("files"),
        F.lit(TREE).alias("hash_scheme"),
    )


def tree_nodes(rows: DataFrame, depth: int = _DEPTH) -> DataFrame:
    """digits, prefix, node, n: every node of the hash tree, the root with 0 digits.  The two lowest levels, which grow
    with the rows, are written once: all others start from them."""
    level = cut_lineage(_leaf_level(rows, depth))
    nodes = level.withColumn("digits", F.lit(2 * depth))
    for digits in range(2 * depth - 2, -1, -2):
        level = _parents(level, digits)
        if digits == 2 * depth - 2:
            level = cut_lineage(level)
        nodes = nodes.unionByName(level.withColumn("digits", F.lit(digits)))
    return nodes.select("digits", "prefix", "node", "n")


def tree_leaves(rows: DataFrame) -> DataFrame:
    """leaf, branch (its first two digits) and the files of every manifest row, in leaf order, so that
    a reader that filters on branches skips the rest."""
    leaf = F.sha2(_record_line(), 256)
    return rows.select(
        leaf.alias("leaf"),
        F.substring(leaf, 1, 2).alias("branch"),
        *("image", "label", "image_sha256", "label_sha256"),
    ).sort("leaf")


def differing_prefixes(old: DataFrame, new: DataFrame, depth: int = _DEPTH) -> DataFrame:
    """prefix of the lowest nodes that differ between two trees, found from the root downwards: the
    children of equal nodes are not compared.  What differs on a level is written once, as both sides of the next
    one start from it."""
    differing = None
    for digits in range(0, 2 * depth + 1, 2):
        sides = []
        for nodes in (old, new):
            level = nodes.where(F.col("digits") == digits).select("prefix", "node")
            if differing is not None:
                parents = differing.select(F.col("prefix").alias("parent"))
                level = level.join(parents, F.substring("prefix", 1, digits - 2) == F.col("parent"), "left_semi")
            sides.append(level)
        known, found = sides[0].withColumnRenamed("node", "known"), sides[1].withColumnRenamed("node", "found")
        both = known.join(found, "prefix", "full_outer")
        differing = cut_lineage(both.where(~F.col("known").eqNullSafe(F.col("found"))).select("prefix"))
    return differing


def manifest_changes(
    old_leaves: DataFrame, old_nodes: DataFrame, new_leaves: DataFrame, new_nodes: DataFrame, depth: int = _DEPTH
) -> DataFrame:
    """image, change of every file that differs between two manifests: added, removed, image, label,
    image_and_label, or label_path.  Images are named once in a manifest.

    Only the leaves below differing nodes are joined; only branches with a difference, of the 256
    there are, are read.  Equal manifests read one node each.
    """
    prefixes = differing_prefixes(old_nodes, new_nodes, depth)
    branches = [row[0] for row in prefixes.select(F.substring("prefix", 1, 2)).distinct().collect()]  # at most 256

    def below(leaves: DataFrame, side: str) -> DataFrame:
        near = leaves.where(F.col("branch").isin(branches))
        kept = near.join(prefixes, F.substring("leaf", 1, 2 * depth) == F.col("prefix"), "left_semi")
        names = ("leaf", "label", "image_sha256", "label_sha256")
        return kept.select("image", *(F.col(c).alias(f"{side}_{c}") for c in names))

    both = below(old_leaves, "old").join(below(new_leaves, "new"), "image", "full_outer")
    image = F.col("old_image_sha256") != F.col("new_image_sha256")
    label = F.col("old_label_sha256") != F.col("new_label_sha256")
    change = (
        F.when(F.col("old_leaf").isNull(), "added")
        .when(F.col("new_leaf").isNull(), "removed")
        .when(image & label, "image_and_label")
        .when(image, "image")
        .when(label, "label")
        .otherwise("label_path")
    )
    return both.where(~F.col("old_leaf").eqNullSafe(F.col("new_leaf"))).select("image", change.alias("change"))


def dataset_digest(rows: DataFrame, scheme: str | None = None) -> DataFrame:
    """One row: dataset_sha256, files, hash_scheme.  The tree is the scheme at every size; the
    ordered form is made where it is named.  The scheme is part of the fingerprint."""
    if scheme == EXACT:
        return ordered_digest(rows)
    if scheme in (None, TREE):
        return tree_digest(rows)
    raise ValueError(f"unknown hash scheme: {scheme}")


def manifest_status(expected: DataFrame, images: DataFrame, labels: DataFrame) -> DataFrame:
    """Every manifest row with `status`: ok, absolute_path, missing_file, image_mismatch or
    label_mismatch.  `images` and `labels` have path (relative to the root) and sha256 as found."""
    found_image = images.select(F.col("path").alias("image"), F.col("sha256").alias("actual_image"))
    found_label = labels.select(F.col("path").alias("label"), F.col("sha256").alias("actual_label"))
    joined = expected.join(found_image, "image", "left").join(found_label, "label", "left")
    status = (
        F.when(F.startswith("image", F.lit("/")) | F.startswith("label", F.lit("/")), "absolute_path")
        .when(F.col("actual_image").isNull() | F.col("actual_label").isNull(), "missing_file")
        .when(F.col("actual_image") != F.col("image_sha256"), "image_mismatch")
        .when(F.col("actual_label") != F.col("label_sha256"), "label_mismatch")
        .otherwise("ok")
    )
    return joined.withColumn("status", status)


def verify_manifest(status: DataFrame, recorded: DataFrame, expected_sha256: str | Column) -> DataFrame:
    """One row: expected, recorded and computed digest, files verified, bad files, passed.  The
    digest is recomputed from the files as found, by the recorded scheme.  `recorded` is the one-row
    table that `dataset_digest` made."""
    found = status.select(
        "split",
        "image",
        "label",
        F.col("actual_image").alias("image_sha256"),
        F.col("actual_label").alias("label_sha256"),
    )
    written = recorded.select("dataset_sha256", "hash_scheme", "files").first()
    if written is None or not written["files"]:
        raise ValueError("the manifest has no file records")
    computed = dataset_digest(found, written["hash_scheme"])
    bad = status.agg(F.count_if(F.col("status") != "ok").alias("n")).scalar()
    recorded_sha256 = F.lit(written["dataset_sha256"])
    return computed.select(
        F.lit(expected_sha256).alias("expected_sha256"),
        recorded_sha256.alias("manifest_sha256"),
        F.col("dataset_sha256").alias("computed_sha256"),
        F.col("files").alias("files_verified"),
        bad.alias("bad_files"),
    ).withColumn(
        "passed",
        (F.col("expected_sha256") == F.col("manifest_sha256"))
        & (F.col("manifest_sha256") == F.col("computed_sha256"))
        & (F.col("bad_files") == 0),
    )


def require_verified(verification: DataFrame) -> None:
    row = verification.first()
    if not row["passed"]:
        raise RuntimeError(f"frozen dataset does not match its fingerprint: {row.asDict()}")


def freeze_counts(
    records: DataFrame,
    groups: DataFrame,
    judged: DataFrame,
    final: DataFrame,
    removed: Collection[str],
) -> DataFrame:
    """One row with the counts of a freeze.  `groups` are the duplicate groups, `judged` the records
    with their winner."""
    inputs = records.agg(
        F.count("*").alias("input_images"),
        *(
            F.coalesce(F.sum(F.get("removed_counts", i)), F.lit(0)).cast("bigint").alias(f"input_{name}")
            for i, name in enumerate(removed)
        ),
    )
    duplicates = groups.agg(
        F.count("*").alias("n"), F.count_if(~F.col("consistent")).alias("bad")
    ).select(F.struct("n", "bad").alias("s")).scalar()
    dropped = judged.agg(
        F.count_if(~F.col("is_kept")).alias("copies"),
        F.count_if(F.col("is_kept") & (F.col("object_count") == 0)).alias("empty"),
    ).select(F.struct("copies", "empty").alias("s")).scalar()
    outputs = (
        final.groupBy("source_key")
        .agg(F.count("*").alias("images"), F.sum("object_count").alias("objects"))
        .agg(
            F.coalesce(F.sum("images"), F.lit(0)).alias("images"),
            F.coalesce(F.sum("objects"), F.lit(0)).alias("objects"),
            F.count("*").alias("sources"),
        )
        .select(F.struct("images", "objects", "sources").alias("s"))
        .scalar()
    )
    return inputs.select(
        "input_images",
        duplicates["n"].alias("duplicate_groups"),
        duplicates["bad"].alias("inconsistent_groups"),
        dropped["copies"].alias("duplicates_removed"),
        dropped["empty"].alias("emptied_removed"),
        outputs["images"].alias("final_images"),
        outputs["objects"].alias("final_annotations"),
        outputs["sources"].alias("source_groups"),
        *(f"input_{name}" for name in removed),
    )
