import random

import pytest
from pyspark.sql import functions as F

from annolytics.operators import dedup, freeze, split
from annolytics.taxonomy import Taxonomy

RATIOS = {"train": 0.7, "valid": 0.2, "test": 0.1}
NAMES = Taxonomy.of(["a", "b", "c"])
RECORD = (
    "path string, label_path string, split string, source_key string, digest string, "
    "output_lines array<string>, class_counts array<long>, removed_counts array<long>, object_count long"
)


def record(path, key, digest, counts, lines=None):
    lines = [f"{k} x" for k, n in enumerate(counts) for _ in range(n)] if lines is None else lines
    return (path, path + ".txt", "train", key, digest, lines, list(counts), [0], len(lines))


def many(spark, n=600):
    rng = random.Random(11)
    rows = [
        record(f"/i/{i}", f"s{min(i // 3, 150)}", f"d{i}", (rng.randrange(4), rng.randrange(2), int(i % 40 == 0)))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, RECORD)


def test_groups_stay_whole_and_partitioning_does_not_matter(spark):
    records = many(spark)
    groups = split.source_groups(records, 3)
    one = split.assign_splits(groups.repartition(1), 3, RATIOS).select("source_key", "split")
    many_ = split.assign_splits(groups.repartition(16), 3, RATIOS).select("source_key", "split")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many_.collect()))
    assert one.count() == groups.count()
    other = split.assign_splits(groups, 3, RATIOS, seed=1).select("source_key", "split")
    assert sorted(map(tuple, other.collect())) != sorted(map(tuple, one.collect()))


def test_refinement_never_makes_the_objective_worse(spark):
    assigned = split.assign_splits(split.source_groups(many(spark), 3), 3, RATIOS)
    refined = split.refine_splits(assigned, 3, RATIOS)

    def score(df):
        return split.split_objective(split.split_sums(df, 3, list(RATIOS)), RATIOS, 3).first()[0]

    assert score(refined) <= score(assigned)
    assert refined.select("source_key").distinct().count() == assigned.count() == refined.count()
    assert refined.agg(F.sum("size")).first()[0] == 600


def test_objective_by_hand(spark):
    sums = spark.createDataFrame(
        [("train", 7, [1, 0, 0], [1, 0, 0]), ("valid", 3, [0, 0, 0], [0, 0, 0]), ("test", 0, [0, 0, 0], [0, 0, 0])],
        "split string, images long, class_counts array<long>, class_image_counts array<long>",
    )
    found = split.split_objective(sums, RATIOS, 3).first()[0]
    # images: (0, 1/2, -1); every class target is below 1 and counts as 1.
    assert found == pytest.approx(8 * (0.25 + 1) + 5 * 8)


def test_coverage_guard(spark):
    sums = spark.createDataFrame(
        [("train", 1, [1, 1, 1], [1, 1, 1]), ("test", 1, [1, 0, 1], [1, 0, 1])],
        "split string, images long, class_counts array<long>, class_image_counts array<long>",
    )
    assert [tuple(r) for r in split.coverage_gaps(sums, NAMES, ["a", "b"]).collect()] == [("test", "b")]
    split.require_coverage(sums, NAMES, ["a", "c"])
    with pytest.raises(RuntimeError, match="b"):
        split.require_coverage(sums, NAMES, ["b"])


def test_winner_has_most_objects_then_smallest_path(spark):
    records = spark.createDataFrame(
        [
            record("/i/b", "b", "x", (1, 0, 0)),
            record("/i/a", "a", "x", (1, 0, 0)),
            record("/i/c", "c", "x", (0, 0, 0)),
            record("/i/d", "d", "y", (0, 0, 0)),
            record("/i/f", "f", "z", (0, 2, 0)),
            record("/i/e", "e", "z", (0, 1, 0)),
        ],
        RECORD,
    )
    groups = {r["digest"]: r for r in dedup.duplicate_groups(records).collect()}
    assert groups["x"]["kept_image"] == "/i/a" and groups["z"]["kept_image"] == "/i/f"
    assert not groups["x"]["consistent"] and groups["x"]["copies"] == 3
    judged = dedup.with_winner(records)
    removed = {(r["image"], r["reason"]) for r in dedup.removed_files(judged).collect()}
    assert removed == {
        ("/i/b", "duplicate_sha256"), ("/i/c", "duplicate_sha256"), ("/i/e", "duplicate_sha256"),
        ("/i/d", "empty_after_class_filter"),
    }
    kept = {r["path"] for r in dedup.retained_records(judged).collect()}
    assert kept == {"/i/a", "/i/f"}


def test_leakage_and_tampering_are_seen(spark):
    final = spark.createDataFrame(
        [
            ("train", "train/images/a.jpg", "train/labels/a.txt", "h1", "l1", "k1"),
            ("test", "test/images/b.jpg", "test/labels/b.txt", "h1", "l2", "k1"),
            ("test", "test/images/c.jpg", "test/labels/c.txt", "h2", "l3", "k2"),
        ],
        "split string, image string, label string, image_sha256 string, label_sha256 string, source_key string",
    )
    audit = freeze.leakage_audit(final).first()
    assert tuple(audit) == (1, 1, 1, False)
    assert [tuple(r) for r in freeze.source_leakage(final).collect()] == [("k1", ["test", "train"])]

    images = final.select(F.col("image").alias("path"), F.col("image_sha256").alias("sha256"))
    labels = final.select(
        F.col("label").alias("path"),
        F.when(F.col("label_sha256") == "l3", "bad").otherwise(F.col("label_sha256")).alias("sha256"),
    )
    status = freeze.manifest_status(final, images, labels)
    assert {r["image"]: r["status"] for r in status.collect()}["test/images/c.jpg"] == "label_mismatch"
    recorded = freeze.dataset_digest(final)
    verified = freeze.verify_manifest(status, recorded, recorded.first()[0])
    assert not verified.first()["passed"] and verified.first()["bad_files"] == 1
    with pytest.raises(RuntimeError):
        freeze.require_verified(verified)


def test_digest_schemes(spark):
    rows = spark.range(50).select(
        F.lit("train").alias("split"),
        F.concat(F.lit("i"), "id").alias("image"),
        F.lit("a").alias("image_sha256"),
        F.concat(F.lit("l"), "id").alias("label"),
        F.lit("b").alias("label_sha256"),
    )
    assert freeze.dataset_digest(rows, freeze.EXACT).first()["hash_scheme"] == freeze.EXACT
    tree = freeze.dataset_digest(rows).first()
    assert tree["hash_scheme"] == freeze.TREE and tree["files"] == 50
    assert freeze.tree_digest(rows.repartition(9)).first() == tree
    changed = rows.withColumn("image_sha256", F.when(F.col("image") == "i7", "x").otherwise("a"))
    assert freeze.tree_digest(changed).first()[0] != tree[0]
    with pytest.raises(ValueError, match="unknown hash scheme"):
        freeze.dataset_digest(rows, "other")


GROUP = "source_key string, size long, class_counts array<long>, class_image_counts array<long>, split string"


def placed(spark, *rows):
    return spark.createDataFrame([(k, n, [0] * len(c), c, s) for k, n, c, s in rows], GROUP)


def gaps(groups, required):
    found = split.coverage_gaps(split.split_sums(groups, 3, list(RATIOS)), NAMES, required).collect()
    return {(r["split"], r["class_name"]) for r in found}


def test_each_level_of_two_trees_is_compared_once(spark):
    schema = "image string, image_sha256 string, label string, label_sha256 string"
    old = [(f"train/images/{i}.jpg", f"i{i}", f"train/labels/{i}.txt", f"l{i}") for i in range(300)]
    new = [(image, "x" if i == 7 else a, label, "y" if i in (7, 8) else b) for i, (image, a, label, b) in enumerate(old)]
    new = [row for i, row in enumerate(new) if i != 9] + [("train/images/n.jpg", "i", "train/labels/n.txt", "l")]
    trees = [freeze.tree_nodes(spark.createDataFrame(rows, schema)) for rows in (old, new)]
    differing = freeze.differing_prefixes(*trees)
    # the rows are there: nothing of the levels above is left in the plan
    assert "Join" not in differing._jdf.queryExecution().analyzed().toString()
    lowest = [{(r["prefix"], r["node"]) for r in t.where("digits = 6").collect()} for t in trees]
    assert {r["prefix"] for r in differing.collect()} == {prefix for prefix, _ in lowest[0] ^ lowest[1]}
    leaves = [freeze.tree_leaves(spark.createDataFrame(rows, schema)) for rows in (old, new)]
    changes = freeze.manifest_changes(leaves[0], trees[0], leaves[1], trees[1])
    assert {tuple(r) for r in changes.collect()} == {
        ("train/images/7.jpg", "image_and_label"), ("train/images/8.jpg", "label"),
        ("train/images/9.jpg", "removed"), ("train/images/n.jpg", "added"),
    }
    assert freeze.differing_prefixes(trees[0], trees[0]).isEmpty()


def test_repair_closes_gaps_without_opening_others(spark):
    groups = placed(
        spark,
        ("k1", 90, [90, 1, 0], "train"),  # too large to be the cheapest
        ("k2", 2, [2, 0, 0], "train"),
        ("k3", 2, [2, 0, 0], "train"),
        ("k4", 9, [9, 9, 0], "valid"),
        ("k5", 3, [0, 3, 0], "test"),
        ("k6", 3, [0, 3, 0], "test"),
    )
    assert gaps(groups, ["a", "b"]) == {("test", "a")}
    fixed = split.repair_coverage(groups, NAMES, ["a", "b"], RATIOS)
    assert gaps(fixed, ["a", "b"]) == set()
    moved = {r["source_key"]: r["split"] for r in fixed.collect()}
    # equal costs: the smaller key; k4 may not leave, as it holds all of a and b in its split
    assert moved == {"k1": "train", "k2": "test", "k3": "train", "k4": "valid", "k5": "test", "k6": "test"}


def test_repair_leaves_what_cannot_be_spared(spark):
    groups = placed(spark, ("k1", 5, [5, 1, 0], "train"), ("k2", 3, [0, 3, 0], "valid"), ("k3", 1, [1, 1, 0], "test"))
    fixed = split.repair_coverage(groups, NAMES, ["a", "c"], RATIOS)
    assert sorted(map(tuple, fixed.collect())) == sorted(map(tuple, groups.collect()))
    assert ("valid", "a") in gaps(fixed, ["a", "c"])
    with pytest.raises(RuntimeError, match="c [(]train[)]"):
        split.require_coverage(split.split_sums(fixed, 3, list(RATIOS)), NAMES, ["a", "c"])
    none = groups.where("false")
    assert split.repair_coverage(none, NAMES, ["a"], RATIOS).count() == 0
