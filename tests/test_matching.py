import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from annolytics import settings
from annolytics.operators import components, errors, matching, metrics, spatial
from annolytics.taxonomy import Taxonomy

BOX = "image_id long, idx long, class_id long, x1 double, y1 double, x2 double, y2 double"


def iou(a, b):
    shared = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared
    return shared / union if union else 0.0


def random_boxes(rng, images, per_image, classes=2, scale=1.0):
    rows = []
    for image in range(images):
        for idx in range(rng.randint(0, per_image)):
            w, h = (scale * 2 ** rng.uniform(-2, 8) for _ in range(2))
            x, y = rng.uniform(-50, 300), rng.uniform(-50, 300)
            rows.append((image, idx, rng.randrange(classes), x, y, x + w, y + h))
        rows.append((image, 1000, 0, 5.0, 5.0, 5.0, 9.0))  # no area
        rows.append((image, 1001, 0, 10.0, 10.0, 20.0, 20.0))  # the same box everywhere
        rows.append((image, 1002, 0, 10.0, 10.0, 20.0, 20.0))
    return rows


def jittered(rng, rows):
    return [
        (i, k, c, *(v + rng.uniform(-3, 3) for v in box)) if k < 1000 else (i, k, c, *box)
        for i, k, c, *box in rows
    ]


def greedy(truth, predictions, threshold):
    """One image at a time, the plain way."""
    found = set()
    for image in {row[0] for row in truth}:
        gts = [r for r in truth if r[0] == image]
        prs = [r for r in predictions if r[0] == image]
        pairs = sorted(
            (
                (iou(g[3:], p[3:]), g[1], p[1])
                for g in gts for p in prs
                if g[2] == p[2] and iou(g[3:], p[3:]) >= threshold
            ),
            reverse=True,
        )
        used_g, used_p = set(), set()
        for _, g, p in pairs:
            if g not in used_g and p not in used_p:
                used_g.add(g)
                used_p.add(p)
                found.add((image, g, p))
    return found


@pytest.mark.parametrize("threshold", [0.05, 0.1, 0.3, 0.5, 0.9])
def test_the_grid_finds_every_pair_once(spark, threshold):
    rng = random.Random(threshold)
    left = random_boxes(rng, 4, 40)
    right = jittered(rng, left)
    pairs = spatial.overlapping_pairs(
        spark.createDataFrame(left, BOX), spark.createDataFrame(right, BOX), ["image_id"], threshold
    ).select("image_id", "l_idx", "r_idx").collect()
    expected = sorted(
        (a[0], a[1], b[1]) for a in left for b in right if a[0] == b[0] and iou(a[3:], b[3:]) >= threshold
    )
    assert sorted(map(tuple, pairs)) == expected


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_matching_equals_the_plain_greedy_way(spark, rounds):
    rng = random.Random(7)
    truth = random_boxes(rng, 6, 25)
    predictions = jittered(rng, truth)
    candidates = matching.match_candidates(
        spark.createDataFrame(truth, BOX), spark.createDataFrame(predictions, BOX), 0.3
    )
    matches = matching.greedy_match(candidates, rounds).collect()
    assert {(m["image_id"], m["gi"], m["pi"]) for m in matches} == greedy(truth, predictions, 0.3)
    assert len(matches) == len(greedy(truth, predictions, 0.3))


@pytest.mark.parametrize("rounds", [0, 2])
def test_crowds_are_matched_component_by_component(spark, monkeypatch, rounds):
    rng = random.Random(11)
    truth = random_boxes(rng, 5, 30)
    predictions = jittered(rng, truth)
    candidates = matching.match_candidates(
        spark.createDataFrame(truth, BOX), spark.createDataFrame(predictions, BOX), 0.2
    )
    monkeypatch.setattr(matching, "CROWD", 3)
    sizes = candidates.groupBy(*matching.GROUP).count().agg(F.min("count"), F.max("count")).first()
    assert sizes[0] <= 3 < sizes[1]  # some groups are cut, some are not
    matches = matching.greedy_match(candidates, rounds).collect()
    assert {(m["image_id"], m["gi"], m["pi"]) for m in matches} == greedy(truth, predictions, 0.2)
    assert len(matches) == len(greedy(truth, predictions, 0.2))
    parts = matching._parts(candidates)
    spread = parts.groupBy(*matching.GROUP).agg(F.countDistinct("part").alias("parts")).agg(F.max("parts")).first()[0]
    assert spread > 1
    for box in ("gi", "pi"):  # no box lies in two parts
        shared = parts.groupBy(*matching.GROUP, box).agg(F.countDistinct("part").alias("parts")).where("parts > 1")
        assert shared.isEmpty()


@pytest.mark.parametrize("kind", ["random", "path", "hub", "none"])
def test_components_equal_a_plain_search(spark, monkeypatch, kind):
    rng = random.Random(3)
    edges = {
        "random": [(rng.randrange(2), rng.randrange(60), rng.randrange(60)) for _ in range(70)],
        "path": [(0, k, k + 1) for k in range(400)] + [(1, 5, 5)],
        "hub": [(0, 500, k) for k in range(300)] + [(1, 0, 1)],
        "none": [],
    }[kind]
    rng.shuffle(edges)
    root = {}

    def find(node):
        while root.setdefault(node, node) != node:
            node = root[node]
        return node

    for key, u, v in edges:
        a, b = sorted((find((key, u)), find((key, v))))
        root[b] = a
    cuts = []
    cut = components.cut_lineage
    monkeypatch.setattr(components, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    found = components.connected(spark.createDataFrame(edges, "key int, u long, v long"), ["key"]).collect()
    assert sorted(((r.key, r.node), (r.key, r.root)) for r in found) == sorted((n, find(n)) for n in root)
    assert len(cuts) <= 14


def test_ties_go_to_the_larger_indices(spark):
    rows = [(1, 0, 0.5), (1, 1, 0.5), (0, 1, 0.5), (0, 0, 0.4)]
    df = spark.createDataFrame([(9, 0, g, p, v) for g, p, v in rows], "image_id long, class_id long, gi long, pi long, iou double")
    for rounds in (2, 0):
        found = {(r["gi"], r["pi"]) for r in matching.greedy_match(df, rounds).collect()}
        assert found == {(1, 1), (0, 0)}


def test_long_chains_need_no_more_jobs(spark, monkeypatch):
    cuts = []
    cut = matching.cut_lineage
    monkeypatch.setattr(matching, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    schema = "image_id long, class_id long, gi long, pi long, iou double"
    used = []
    for n in (8, 32):
        # candidate k shares a box with k + 1, and each is better than the next
        rows = [(1, 0, (k + 1) // 2, k // 2, 1.0 - k / 100) for k in range(n)]
        cuts.clear()
        found = {(r["gi"], r["pi"]) for r in matching.greedy_match(spark.createDataFrame(rows, schema)).collect()}
        assert found == {(k, k) for k in range(n // 2)}
        used.append(len(cuts))
    assert used[0] == used[1]


def test_no_pair_explosion_in_the_plan(spark):
    boxes = spark.createDataFrame(random_boxes(random.Random(1), 2, 3), BOX)
    pairs = spatial.overlapping_pairs(boxes, boxes, ["image_id"], 0.1)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "SortMergeJoin" in plan


def test_error_categories(spark):
    # image 1: a miss, an extra of another class on it, a low box; image 2: eight truths, none found.
    truth = [(1, 0, 0, 0.0, 0.0, 50.0, 50.0), (1, 1, 1, 200.0, 200.0, 210.0, 210.0)]
    truth += [(2, i, 0, 30.0 * i, 0.0, 30.0 * i + 40.0, 40.0) for i in range(8)]
    predictions = [
        (1, 0, 2, 0.0, 0.0, 50.0, 50.0, 0.9),
        (1, 1, 1, 200.0, 200.0, 210.0, 210.0, 0.2),
        (1, 2, 1, 200.0, 200.0, 210.0, 210.0, 0.05),
    ]
    truth_df = spark.createDataFrame(truth, BOX).withColumns({"width": F.lit(300), "height": F.lit(300)})
    found = errors.image_errors(truth_df, spark.createDataFrame(predictions, BOX + ", conf double"))
    totals = {r["category"]: (r["events"], r["images"]) for r in errors.error_categories(found).collect()}
    assert totals == {
        "low_confidence": (1, 1),
        "suspected_missed_detection": (10, 2),
        "suspected_false_positive": (1, 1),
        "class_confusion": (1, 1),
        "small_object_failure": (1, 1),
        "occlusion_scene_failure": (8, 1),
        "dense_scene_failure": (8, 1),
    }
    first = errors.error_examples(found, k=1).where("category = 'suspected_missed_detection'").collect()
    assert [(r["image_id"], r["rank"]) for r in first] == [(1, 1)]


def test_error_categories_without_any_box(spark):
    empty = spark.createDataFrame([], BOX + ", conf double, width int, height int")
    totals = errors.error_categories(errors.image_errors(empty, empty)).collect()
    assert [(r["category"], r["events"], r["images"]) for r in totals] == [
        (c, 0, 0) for c in settings.ERROR_CATEGORIES
    ]


def test_average_precision_by_hand(spark):
    truth = [(1, 0, 0, 0.0, 0.0, 10.0, 10.0), (2, 0, 0, 0.0, 0.0, 10.0, 10.0)]
    predictions = [
        (1, 0, 0, 0.0, 0.0, 10.0, 10.0, 0.9),  # a hit at every threshold
        (1, 1, 0, 50.0, 50.0, 60.0, 60.0, 0.8),  # wrong
        (2, 0, 0, 0.0, 0.0, 10.0, 6.0, 0.7),  # IoU 0.6
    ]
    truth_df, pred_df = spark.createDataFrame(truth, BOX), spark.createDataFrame(predictions, BOX + ", conf double")
    matched = metrics.matched_predictions(truth_df, pred_df)
    ap = {
        round(r["iou_threshold"] * 100): r["ap"]
        for r in metrics.average_precision(metrics.precision_recall_curve(matched, truth_df)).collect()
    }
    both, one = (51 + 50 * 2 / 3) / 101, 51 / 101
    assert all(ap[t] == pytest.approx(both) for t in (50, 55, 60))
    assert all(ap[t] == pytest.approx(one) for t in range(65, 100, 5))
    rows = metrics.detection_metrics(matched, truth_df, Taxonomy.of(["a", "absent"])).collect()
    by_class = {r["class_name"]: r for r in rows}
    assert by_class["a"]["precision"] == pytest.approx(2 / 3) and by_class["a"]["recall"] == 1.0
    assert by_class["a"]["ap50"] == pytest.approx(both)
    assert by_class["a"]["ap50_95"] == pytest.approx((3 * both + 7 * one) / 10)
    assert tuple(by_class["absent"])[2:] == (0.0, 0.0, 0.0, 0.0)
    assert metrics.prediction_count(pred_df, 0.75).first()[0] == 2


def test_components_of_few_edges_need_no_rounds(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(k % 5, rng.choice([None, *range(30)]), rng.randrange(30)) for k in range(150)] + [(9, 1, 1), (None, 3, 4)]
    df = spark.createDataFrame(rows, "key int, g long, p long").selectExpr(
        "key", "struct(0 as side, g) as u", "struct(1 as side, p as g) as v"
    )
    cuts = []
    cut = components.cut_lineage
    monkeypatch.setattr(components, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    spread = sorted(map(repr, components.connected(df, ["key"], crowd=0).collect()))
    assert sorted(map(repr, components.connected(df, ["key"], crowd=40).collect())) == spread
    cuts.clear()
    assert sorted(map(repr, components.connected(df.where("key >= 0"), ["key"]).collect())) == [
        r for r in spread if "key=None" not in r
    ]
    assert len(cuts) == 1


def test_few_boxes_are_joined_as_they_are(spark, monkeypatch):
    rng = random.Random(9)
    boxes = random_boxes(rng, 3, 40)
    df = spark.createDataFrame(boxes, BOX)
    pairs = spatial.overlapping_pairs(df, df, ["image_id", "class_id"], 0.1)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortMergeJoin" in plan
    few = sorted(map(repr, pairs.collect()))
    hidden = matching.overlapping_truth(df, df)
    assert "Generate" not in hidden._jdf.queryExecution().executedPlan().toString()
    found = sorted(map(repr, hidden.collect()))
    for most in (0, 39):
        monkeypatch.setattr(spatial, "FEW", most)
        pairs = spatial.overlapping_pairs(df, df, ["image_id", "class_id"], 0.1)
        assert sorted(map(repr, pairs.collect())) == few
        assert sorted(map(repr, matching.overlapping_truth(df, df).collect())) == found


def test_images_of_few_boxes_move_once_and_count_as_the_operators_do(spark):
    schema = "image_id bigint, idx bigint, class_id bigint, x1 double, y1 double, x2 double, y2 double"
    draw = random.Random(11)

    def boxes(image):
        rows = []
        for idx in range(draw.randrange(1, 9)):
            x, y, size = draw.randrange(6), draw.randrange(6), draw.randrange(0, 9)
            rows.append((image, draw.choice((idx, idx, 0, None)), draw.choice((0, 0, 1, None)), x, y, x + size, y + 6))
        return [tuple(float(v) if i > 2 else v for i, v in enumerate(row)) for row in rows]

    truth = [(*r, 640, 640) for i in range(40) for r in boxes(i)] + [(None, 0, 0, 0.0, 0.0, 5.0, 5.0, 640, 640)]
    predictions = [(*r, draw.choice((0.05, 0.15, 0.9, 0.8))) for i in range(40) for r in boxes(i)]
    truth_df = spark.createDataFrame(truth, schema + ", width int, height int")
    predictions_df = spark.createDataFrame(predictions, schema + ", conf double")
    found = errors.image_errors(truth_df, predictions_df)

    in_use = predictions_df.where("conf >= 0.25")
    matches = matching.greedy_match(matching.match_candidates(truth_df, in_use))
    missed, extra = matching.unmatched(truth_df, matches, "gi"), matching.unmatched(in_use, matches, "pi")
    wanted = {}
    for column, rows in (
        ("suspected_missed_detection", missed.groupBy("image_id").count()),
        ("suspected_false_positive", extra.groupBy("image_id").count()),
        ("class_confusion", matching.class_confusions(missed, extra).groupBy("image_id").count()),
        ("occlusion_scene_failure", matching.overlapping_truth(missed, truth_df).groupBy("image_id").count()),
    ):
        wanted[column] = {r[0]: r[1] for r in rows.collect()}
    for row in found.collect():
        for column, counts in wanted.items():
            assert row[column] == counts.get(row["image_id"], 0), (row, column)

    named = errors.image_errors(truth_df.where("image_id IS NOT NULL"), predictions_df)
    plan = named._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 0
    assert named.agg({"suspected_missed_detection": "sum"}).first()[0] == missed.where("image_id IS NOT NULL").count()


def test_confusions_count_boxes_without_matching_them_again(spark, sf_dir, monkeypatch):
    draw = random.Random(12)
    truth = random_boxes(draw, 4, 30)
    predictions = [(i, k, (c + draw.randrange(2)) % 2, *box) for i, k, c, *box in jittered(draw, truth)]
    truth_df, predictions_df = spark.createDataFrame(truth, BOX), spark.createDataFrame(predictions, BOX)
    found = matching.greedy_match(matching.match_candidates(truth_df, predictions_df))
    missed, extra = matching.unmatched(truth_df, found, "gi"), matching.unmatched(predictions_df, found, "pi")
    wanted = sorted(map(repr, matching.class_confusions(missed, extra).collect()))
    assert wanted
    read = []
    counting = spatial.crowded_images

    def crowded(image, *sides, **options):
        read.extend(side._jdf.queryExecution().analyzed().toString() for side in sides)
        return counting(image, *sides, **options)

    monkeypatch.setattr(spatial, "crowded_images", crowded)
    for most in (64, 10, 0):
        monkeypatch.setattr(spatial, "FEW", most)
        confusions = matching.class_confusions(missed, extra, counted=(truth_df, predictions_df))
        assert sorted(map(repr, confusions.collect())) == wanted
    assert len(read) == 6 and not any("Join" in plan for plan in read)
    read.clear()
    registry.queries()["class_confusions"](spark, sf_dir)
    assert read and not any("Join" in plan for plan in read)
