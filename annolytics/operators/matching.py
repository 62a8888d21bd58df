"""Greedy one-to-one matching of predictions to ground truth."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolytics import settings
from annolytics.functions.boxes import iou
from annolytics.operators.components import connected
from annolytics.operators.spatial import CORNERS, crowded_images, has_area, overlapping_pairs
from annolytics.session import cut_lineage

GROUP = ["image_id", "class_id"]
ROUNDS = 2
CROWD = 100_000  # open candidates of an image and class that one task walks through as one
_BOX = ["image_id", "class_id", "idx", "x1", "y1", "x2", "y2"]


def match_candidates(
    truth: DataFrame, predictions: DataFrame, min_iou: float = settings.MATCH_IOU
) -> DataFrame:
    """Same-class pairs inside an image with IoU >= `min_iou`: image_id, class_id, gi, pi, iou."""
    pairs = overlapping_pairs(truth.select(*_BOX), predictions.select(*_BOX), GROUP, min_iou)
    return pairs.select(*GROUP, F.col("l_idx").alias("gi"), F.col("r_idx").alias("pi"), "iou")


def greedy_match(candidates: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Take candidates by falling (iou, gi, pi) and keep those whose two boxes are both still free.

    A candidate that ranks first for both of its boxes is always taken, and taking all of these at
    once changes nothing for the others.  `rounds` such rounds, spread over the boxes, settle most of
    a group however large it is.  What is left is walked through in order, one group of an image and
    class after the other, remembering used boxes only.  Groups that still have more than CROWD candidates
    are cut into connected components first, which do not share a box, so that they spread over tasks.
    """
    judged = candidates.select(*GROUP, "gi", "pi", "iou", F.lit(None).cast("boolean").alias("taken"))
    for _ in range(rounds):
        judged = _settle_leaders(judged)
    judged = cut_lineage(judged)
    left = judged.where(F.col("taken").isNull()).drop("taken")
    parts = _parts(left)
    ordered = parts.repartition(*GROUP, "part").sortWithinPartitions(
        *GROUP, "part", F.desc("iou"), F.desc("gi"), F.desc("pi")
    )
    walked = ordered.mapInPandas(_take_free, left.schema)
    return judged.where("taken").drop("taken").unionByName(walked)


def _settle_leaders(judged: DataFrame) -> DataFrame:
    """Set `taken` of open candidates: true if they lead both of their boxes; rows that lose a box to
    one of these are left out."""
    truth, prediction = Window.partitionBy(*GROUP, "gi"), Window.partitionBy(*GROUP, "pi")
    still_open = F.col("taken").isNull()
    rank = F.struct("iou", "gi", "pi")
    best = F.max(F.when(still_open, rank))
    led = judged.withColumn("leads_truth", rank == best.over(truth)).withColumn(
        "leads", still_open & F.col("leads_truth") & (rank == best.over(prediction))
    )
    used = F.max("leads").over(prediction) | F.max("leads").over(truth)
    return (
        led.withColumn("used", used)
        .where(~still_open | F.col("leads") | ~F.col("used"))
        .select(*GROUP, "gi", "pi", "iou", F.when(F.col("leads"), True).otherwise(F.col("taken")).alias("taken"))
    )


def _parts(left: DataFrame) -> DataFrame:
    """`left` with `part`: candidates of one image and class that share a box, directly or over others, have the
    same.  Only groups of more than CROWD candidates are cut."""
    crowded = left.groupBy(*GROUP).count().where(F.col("count") > CROWD).select(*GROUP)
    if crowded.isEmpty():
        return left.withColumn("part", F.lit(0).cast("bigint"))
    crowded = cut_lineage(crowded)
    parts = match_components(left.join(crowded, GROUP, "left_semi"))
    return left.join(parts, [*GROUP, "gi"], "left").select(*left.columns, F.coalesce("part", F.lit(0)).alias("part"))


def match_components(candidates: DataFrame) -> DataFrame:
    """image_id, class_id, gi, part: truths that compete for predictions, directly or over others, have the same
    part, the least of their indices."""
    # a candidate links its two boxes; sides tell boxes of equal index apart, and put truths first
    truth, prediction = F.struct(F.lit(0).alias("side"), "gi"), F.struct(F.lit(1).alias("side"), F.col("pi").alias("gi"))
    roots = connected(candidates.select(*GROUP, truth.alias("u"), prediction.alias("v")), GROUP)
    return roots.where("node.side = 0").select(*GROUP, F.col("node.gi").alias("gi"), F.col("root.gi").alias("part"))


def _take_free(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    group, truths, predictions = None, set(), set()
    for batch in batches:
        free = []
        for *own, gi, pi in zip(*(batch[c].tolist() for c in (*GROUP, "part", "gi", "pi")), strict=True):
            if own != group:
                group, truths, predictions = own, set(), set()
            free.append(gi not in truths and pi not in predictions)
            if free[-1]:
                truths.add(gi)
                predictions.add(pi)
        yield batch.loc[free, batch.columns != "part"]


def with_match(boxes: DataFrame, matches: DataFrame, index: str) -> DataFrame:
    """`boxes` with `match_iou`: the IoU of their match, null when they have none.  `index` is `gi`
    for ground truth and `pi` for predictions."""
    found = matches.select(*GROUP, F.col(index).alias("idx"), F.col("iou").alias("match_iou"))
    return boxes.join(found, [*GROUP, "idx"], "left")


def unmatched(boxes: DataFrame, matches: DataFrame, index: str) -> DataFrame:
    taken = matches.where(F.col("iou").isNotNull()).select(*GROUP, F.col(index).alias("idx"))
    return boxes.join(taken, [*GROUP, "idx"], "left_anti")


def missed_and_extra(truth: DataFrame, predictions: DataFrame, matches: DataFrame) -> DataFrame:
    """Unmatched boxes of both sides: side (`missed` or `extra`), image_id, class_id, idx, box."""
    missed = unmatched(truth.select(*_BOX), matches, "gi")
    extra = unmatched(predictions.select(*_BOX), matches, "pi")
    return missed.select(F.lit("missed").alias("side"), *_BOX).unionByName(
        extra.select(F.lit("extra").alias("side"), *_BOX)
    )


def class_confusions(
    missed: DataFrame, extra: DataFrame, min_iou: float = settings.MATCH_IOU, counted: Sequence[DataFrame] = ()
) -> DataFrame:
    """Pairs of a missed truth and an extra prediction of another class at the same place; every
    pair counts, so one box may appear in several.  `counted`: the tables that the two sides were taken from, if
    these are not stored, so that counting the boxes of an image does not match them all again."""
    pairs = overlapping_pairs(missed.select(*_BOX), extra.select(*_BOX), ["image_id"], min_iou, counted)
    return pairs.where(F.col("l_class_id") != F.col("r_class_id")).select(
        "image_id",
        F.col("l_idx").alias("gi"),
        F.col("r_idx").alias("pi"),
        F.col("l_class_id").alias("truth_class"),
        F.col("r_class_id").alias("predicted_class"),
        "iou",
    )


_PLACE = ["image_id", "x1", "y1", "x2", "y2"]


def _places(boxes: DataFrame, *more: str) -> DataFrame:
    """Distinct places with the number of boxes there: copies of a box are counted, not paired."""
    return boxes.groupBy(*_PLACE, *more).agg(F.count("*").alias("n"))


def confusion_counts(
    missed: DataFrame, extra: DataFrame, min_iou: float = settings.MATCH_IOU
) -> DataFrame:
    """image_id, confused: how many pairs `class_confusions` would list, without listing them."""
    pairs = overlapping_pairs(
        _places(missed, "class_id"), _places(extra, "class_id"), ["image_id"], min_iou, counted=(missed, extra)
    )
    return (
        pairs.where(F.col("l_class_id") != F.col("r_class_id"))
        .groupBy("image_id")
        .agg(F.sum(F.col("l_n") * F.col("r_n")).alias("confused"))
    )


_CORNERS_OF = ("idx", "class_id", *CORNERS)


def gathered(truth: DataFrame, predictions: DataFrame, *more: str) -> DataFrame:
    """One row per image: image_id, truths and predictions, arrays of boxes.  All boxes move once, in one shuffle.  `more`
    columns stay in the truths.  Images must be named and of few boxes."""
    columns = (*_CORNERS_OF, *more)
    sides = truth.select("image_id", F.lit(True).alias("true"), *columns).unionByName(
        predictions.select("image_id", F.lit(False).alias("true"), *_CORNERS_OF), allowMissingColumns=True
    )

    def boxes(side: Column, names: Sequence[str]) -> Column:
        return F.collect_list(F.when(side, F.struct(*names)))

    return (
        sides.repartition("image_id")
        .groupBy("image_id")
        .agg(boxes(F.col("true"), columns).alias("truths"), boxes(~F.col("true"), _CORNERS_OF).alias("predictions"))
    )


def _corners(box: Column) -> tuple[Column, ...]:
    return tuple(box[c] for c in CORNERS)


def _area(boxes: str | Column) -> Column:
    return F.filter(boxes, lambda b: (b["x2"] > b["x1"]) & (b["y2"] > b["y1"]))


def with_left_over(images: DataFrame, min_iou: float = settings.MATCH_IOU) -> DataFrame:
    """`gathered` images with `missed_boxes` and `extra_boxes`: what `unmatched` leaves of both sides after `match_candidates` and
    `greedy_match`, by the same order and the same threshold."""

    def partners(t: Column) -> Column:
        near = F.filter(
            F.col("__p"), lambda p: (p["class_id"] == t["class_id"]) & (iou(_corners(t), _corners(p)) >= min_iou)
        )
        return F.transform(
            near,
            lambda p: F.struct(
                iou(_corners(t), _corners(p)).alias("iou"),
                F.struct(t["idx"].alias("idx"), t["class_id"].alias("class_id")).alias("truth"),
                F.struct(p["idx"].alias("idx"), p["class_id"].alias("class_id")).alias("prediction"),
            ),
        )

    found = images.withColumns({"__t": _area("truths"), "__p": _area("predictions")})
    found = found.withColumn("__pairs", F.sort_array(F.flatten(F.transform("__t", partners)), asc=False))

    def free(taken: Column, pair: Column) -> Column:
        return ~F.exists(
            taken, lambda m: (m["truth"] == pair["truth"]) | (m["prediction"] == pair["prediction"])
        )

    none = F.filter("__pairs", lambda _: F.lit(False))
    taken = F.aggregate(
        "__pairs", none, lambda acc, pair: F.when(free(acc, pair), F.concat(acc, F.array(pair))).otherwise(acc)
    )

    def left(boxes: str, side: str) -> Column:
        # an index that is null names no box
        return F.filter(
            boxes,
            lambda b: b["idx"].isNull()
            | ~F.exists(
                "__taken",
                lambda m: F.coalesce(
                    (m[side]["idx"] == b["idx"]) & (m[side]["class_id"] == b["class_id"]), F.lit(False)
                ),
            ),
        )

    return (
        found.withColumn("__taken", taken)
        .withColumns({"missed_boxes": left("truths", "truth"), "extra_boxes": left("predictions", "prediction")})
        .drop("__t", "__p", "__pairs", "__taken")
    )


def confused_within(missed: str, extra: str, min_iou: float = settings.MATCH_IOU) -> Column:
    """`confusion_counts` of one image from its arrays."""
    return F.aggregate(
        _area(missed),
        F.lit(0),
        lambda n, t: n
        + F.size(
            F.filter(
                _area(extra), lambda p: (p["class_id"] != t["class_id"]) & (iou(_corners(t), _corners(p)) >= min_iou)
            )
        ),
    )


def occluded_within(boxes: str, truths: str, min_iou: float = settings.OCCLUSION_IOU) -> Column:
    """How many of an image's `boxes` `overlapping_truth` would list, from arrays."""

    def same(b: Column, o: Column) -> Column:
        equal = F.lit(True)
        for c in CORNERS:
            equal = equal & (b[c] == o[c])
        return equal

    def hit(b: Column) -> Column:
        copies = F.size(F.filter(_area(truths), lambda o: same(b, o)))
        near = F.exists(_area(truths), lambda o: ~same(b, o) & (iou(_corners(b), _corners(o)) >= min_iou))
        return (copies > 1) | near

    return F.size(F.filter(_area(boxes), hit))


def overlapping_truth(
    boxes: DataFrame, truth: DataFrame, min_iou: float = settings.OCCLUSION_IOU
) -> DataFrame:
    """Keys (image_id, idx) of those ground-truth `boxes` that overlap another box of `truth`, of any
    class.  Boxes at the very same place overlap each other; only distinct places are compared."""
    crowded = crowded_images("image_id", boxes, truth)
    if crowded is None:
        return _near_others(boxes, truth, min_iou)
    few, many = (
        [side.join(crowded, "image_id", how) for side in (boxes, truth)] for how in ("left_anti", "left_semi")
    )
    return _near_others(*few, min_iou).unionByName(_others_by_place(*many, min_iou))


def _near_others(boxes: DataFrame, truth: DataFrame, min_iou: float) -> DataFrame:
    """`overlapping_truth` of images with few boxes, which move once and are compared where they meet."""
    others = truth.where(has_area()).repartition("image_id")
    others = _places(others).select("image_id", *(F.col(c).alias(f"r_{c}") for c in (*CORNERS, "n")))
    same = F.lit(True)
    for corner in CORNERS:
        same = same & (F.col(corner) == F.col(f"r_{corner}"))
    overlap = iou(tuple(F.col(c) for c in CORNERS), tuple(F.col(f"r_{c}") for c in CORNERS)) >= min_iou
    hit = F.when(same, F.col("r_n") > 1).otherwise(overlap)
    left, right = boxes.where(has_area()).select("image_id", "idx", *CORNERS).alias("b"), others.alias("o")
    met = left.hint("merge").join(right, (F.col("b.image_id") == F.col("o.image_id")) & hit, "left_semi")
    return met.select("image_id", "idx")


def _others_by_place(boxes: DataFrame, truth: DataFrame, min_iou: float) -> DataFrame:
    everywhere = _places(truth)
    shared = everywhere.where((F.col("n") > 1) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    pairs = overlapping_pairs(
        _places(boxes).drop("n"), everywhere.drop("n"), ["image_id"], min_iou, counted=(boxes, truth)
    )
    differs = F.lit(False)
    for corner in _PLACE[1:]:
        differs = differs | (F.col(f"l_{corner}") != F.col(f"r_{corner}"))
    crowded = pairs.where(differs).select("image_id", *(F.col(f"l_{c}").alias(c) for c in _PLACE[1:]))
    hit = crowded.unionByName(shared.drop("n")).distinct()
    return boxes.join(hit, _PLACE, "left_semi").select("image_id", "idx")
