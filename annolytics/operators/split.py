"""Split items by source group with approximate stratification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolytics import settings
from annolytics.operators.running import hash_buckets, running_totals
from annolytics.session import cut_lineage
from annolytics.taxonomy import Taxonomy


def check_ratios(ratios: Mapping[str, float]) -> None:
    if any(ratio <= 0 for ratio in ratios.values()):
        raise ValueError("all split ratios must be greater than zero")
    if abs(sum(ratios.values()) - 1.0) > 1e-9:
        raise ValueError("split ratios must sum to 1")


def source_groups(records: DataFrame, classes: int) -> DataFrame:
    """source_key, size, class_counts, class_image_counts (arrays in class order)."""
    per_class = [F.get("class_counts", i) for i in range(classes)]
    return records.groupBy("source_key").agg(
        F.count("*").alias("size"),
        F.array(*(F.sum(c) for c in per_class)).alias("class_counts"),
        F.array(*(F.count_if(c > 0) for c in per_class)).alias("class_image_counts"),
    )


def assign_splits(
    groups: DataFrame,
    classes: int,
    ratios: Mapping[str, float] = settings.SPLIT_RATIOS,
    seed: int = 42,
) -> DataFrame:
    """Add `stratum` and `split` to every group; a group is never divided.

    The stratum is the group's rarest class, by images over the whole dataset.  Inside a stratum,
    groups stand in a seeded hash order, and the middle of a group on the running image count
    decides which ratio interval it falls into.  The outcome depends only on data and seed.
    """
    check_ratios(ratios)
    totals = groups.agg(
        *(F.coalesce(F.sum(F.get("class_image_counts", i)), F.lit(0)).alias(f"t{i}") for i in range(classes))
    ).select(F.array(*(f"t{i}" for i in range(classes))).alias("totals"))
    here = groups.withColumn("__totals", totals.scalar())
    present = [
        F.when(
            F.get("class_image_counts", i) > 0,
            F.struct(F.get("__totals", i).alias("images"), F.lit(i).alias("class_id")),
        )
        for i in range(classes)
    ]
    rarest = F.array_min(F.array(*present))["class_id"]
    ordered = here.withColumn("stratum", F.coalesce(rarest, F.lit(-1))).drop("__totals")
    ordered = ordered.withColumn(
        "__hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("source_key")), 256)
    )
    placed = running_totals(
        ordered,
        ["stratum"],
        [F.col("__hash"), F.col("source_key")],
        hash_buckets(F.col("__hash")),
        ["size"],
    )
    middle = (F.col("size_upto") * 2 - F.col("size")) / 2.0
    split, reached = None, 0.0
    names = list(ratios)
    for name in names[:-1]:
        reached += ratios[name]
        inside = middle < F.lit(reached) * F.col("size_total")
        split = F.when(inside, name) if split is None else split.when(inside, name)
    split = F.lit(names[-1]) if split is None else split.otherwise(names[-1])
    return placed.withColumn("split", split).drop("__hash", "size_upto", "size_total")


def split_sums(assigned: DataFrame, classes: int, splits: Sequence[str]) -> DataFrame:
    """split, images, class_counts, class_image_counts over the assigned groups, every split once."""
    sums = assigned.groupBy("split").agg(
        F.sum("size").alias("images"),
        *(F.sum(F.get("class_counts", i)).alias(f"a{i}") for i in range(classes)),
        *(F.sum(F.get("class_image_counts", i)).alias(f"c{i}") for i in range(classes)),
    )
    names = assigned.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    zero = F.lit(0).cast("bigint")
    filled = names.join(sums, "split", "left")
    return filled.select(
        "split",
        F.coalesce("images", zero).alias("images"),
        F.array(*(F.coalesce(f"a{i}", zero) for i in range(classes))).alias("class_counts"),
        F.array(*(F.coalesce(f"c{i}", zero) for i in range(classes))).alias("class_image_counts"),
    )


def split_objective(sums: DataFrame, ratios: Mapping[str, float], classes: int) -> DataFrame:
    """One row, `objective`: how far images, annotations and coverage are from their targets.  Squared
    relative errors, weighted 8, 1 and 4; a target is at least 1."""
    measures = ["images", *(f"a{i}" for i in range(classes)), *(f"c{i}" for i in range(classes))]
    flat = sums.select(
        "split",
        "images",
        *(F.get("class_counts", i).alias(f"a{i}") for i in range(classes)),
        *(F.get("class_image_counts", i).alias(f"c{i}") for i in range(classes)),
    )
    by_split = flat.agg(
        *(
            F.sum(F.when(F.col("split") == s, F.col(m))).alias(f"{m}_{s}")
            for m in measures
            for s in ratios
        )
    )
    score: Column = F.lit(0.0)
    for split, ratio in ratios.items():
        for m in measures:
            total = sum((F.col(f"{m}_{s}") for s in ratios), F.lit(0))
            target = F.greatest(total * F.lit(ratio), F.lit(1.0))
            miss = (F.col(f"{m}_{split}") - target) / target
            score = score + _weight(m) * miss * miss
    return by_split.select(score.alias("objective"))


def _weight(measure: str) -> float:
    return 8.0 if measure == "images" else (4.0 if measure.startswith("c") else 1.0)


def split_shares(
    sums: DataFrame, ratios: Mapping[str, float], taxonomy: Taxonomy
) -> tuple[DataFrame, DataFrame]:
    """Two tables: per split the actual, target and deviating share of images; per split and class
    the annotations, images and share of the split's annotations."""
    everything = sums.agg(F.sum("images").alias("n")).scalar()
    target = F.create_map(*(F.lit(p) for pair in ratios.items() for p in pair))[F.col("split")]
    actual = F.coalesce(F.try_divide(F.col("images"), everything), F.lit(0.0))
    annotations = F.aggregate("class_counts", F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    shares = sums.select(
        "split",
        "images",
        annotations.alias("annotations"),
        actual.alias("actual_ratio"),
        target.alias("target_ratio"),
        (actual - target).alias("ratio_deviation"),
    )
    rows = [
        F.struct(
            F.lit(k).cast("bigint").alias("class_id"),
            F.lit(taxonomy.names[k]).alias("class_name"),
            F.get("class_counts", i).alias("annotations"),
            F.get("class_image_counts", i).alias("images"),
            F.coalesce(F.try_divide(F.get("class_counts", i), annotations), F.lit(0.0)).alias("share"),
        )
        for i, k in enumerate(taxonomy.ids)
    ]
    return shares, sums.select("split", F.inline(F.array(*rows)))


def coverage_gaps(sums: DataFrame, taxonomy: Taxonomy, required: Sequence[str]) -> DataFrame:
    """split, class_name of required classes that a split has no image of."""
    rows = [
        F.struct(
            F.lit(name).alias("class_name"),
            F.get("class_image_counts", taxonomy.ids.index(taxonomy.id_of(name))).alias("images"),
        )
        for name in required
    ]
    return sums.select("split", F.inline(F.array(*rows))).where("images = 0").drop("images")


def require_coverage(sums: DataFrame, taxonomy: Taxonomy, required: Sequence[str]) -> None:
    gaps = coverage_gaps(sums, taxonomy, required).collect()  # at most splits x required classes
    if gaps:
        raise RuntimeError(
            "no image of a required class in: "
            + ", ".join(sorted(f"{g['class_name']} ({g['split']})" for g in gaps))
        )


def repair_coverage(
    assigned: DataFrame,
    taxonomy: Taxonomy,
    required: Sequence[str],
    ratios: Mapping[str, float] = settings.SPLIT_RATIOS,
) -> DataFrame:
    """Give every split an image of every required class, as far as groups can be spared.

    Split by split and class by class, a gap is closed by the group whose move costs the objective
    least, the smallest source_key among equals, and that takes no required class from its split
    altogether.  A gap that no group can close stays, for `require_coverage` to report.  Without
    gaps nothing moves.  The driver sees sums per split and one group a gap: at most splits x
    required classes.
    """
    classes, names = len(taxonomy.ids), list(ratios)
    totals, targets, weights = _goals(assigned, classes, ratios)
    places = [1 + classes + taxonomy.ids.index(taxonomy.id_of(name)) for name in required]
    current = assigned
    for target in names:
        for place in places:
            if totals[target][place] > 0:
                continue
            found = _cheapest_donor(current, classes, names, target, place, places, totals, targets, weights)
            if found is None:
                continue
            for m in range(1 + 2 * classes):
                totals[found["split"]][m] -= found["measures"][m]
                totals[target][m] += found["measures"][m]
            chosen = F.col("source_key").eqNullSafe(F.lit(found["source_key"]))
            current = current.withColumn("split", F.when(chosen, target).otherwise(F.col("split")))
    return current


def _cheapest_donor(
    current: DataFrame,
    classes: int,
    names: list[str],
    target: str,
    place: int,
    places: list[int],
    totals: dict[str, list[float]],
    targets: dict[str, list[float]],
    weights: list[float],
):
    """The group with measure `place` whose move to `target` costs least and opens no gap, or None."""
    row = [c.cast("double") for c in _measures(classes)]
    enter = _change(classes, totals[target], targets[target], weights, 1)
    options = []
    for name in names:
        if name != target:
            spared = F.lit(True)
            for p in places:
                spared = spared & ((row[p] == 0) | (F.lit(totals[name][p]) > row[p]))
            leave = _change(classes, totals[name], targets[name], weights, -1)
            options.append(F.when((F.col("split") == name) & spared, leave + enter))
    if not options:
        return None
    priced = current.where(row[place] > 0).select(
        F.coalesce(*options).alias("delta"), "source_key", "split", F.array(*row).alias("measures")
    )
    best = priced.where("delta IS NOT NULL").agg(F.min(F.struct("delta", "source_key", "split", "measures")).alias("m"))
    return best.first()["m"]


def refine_splits(
    assigned: DataFrame,
    classes: int,
    ratios: Mapping[str, float] = settings.SPLIT_RATIOS,
    rounds: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Move groups between splits while the objective falls.

    Every round scores each group's best move against the current totals, as a column expression
    over all groups in parallel.  Good moves made together can overshoot, so the round also sums up
    nested random halves of them, and takes the batch with the lowest true objective; it stops when
    none is lower.  Only sums per batch come to the driver: 3 splits x (1 + 2 x classes) numbers.
    """
    names = list(ratios)
    width = 1 + 2 * classes
    current = cut_lineage(assigned)
    totals, targets, weights = _goals(current, classes, ratios)

    def objective(state: dict[str, list[float]]) -> float:
        return sum(
            weights[m] * ((state[s][m] - targets[s][m]) / targets[s][m]) ** 2
            for s in names
            for m in range(width)
        )

    score = objective(totals)
    for turn in range(rounds):
        # written once a round: the sums and the next round both start from here
        proposed = cut_lineage(
            _best_moves(current, classes, names, totals, targets, weights, f"{seed}:{turn}").drop("delta")
        )
        batches = _batch_sums(proposed, classes)
        best, best_score, best_state = None, score - 1e-12, None
        for smallest in sorted({row["halvings"] for row in batches}):
            state = {s: list(totals[s]) for s in names}
            for row in batches:
                if row["halvings"] >= smallest:
                    for m in range(width):
                        state[row["split"]][m] -= row[f"m{m}"]
                        state[row["target"]][m] += row[f"m{m}"]
            if objective(state) < best_score:
                best, best_score, best_state = smallest, objective(state), state
        if best is None:
            break
        moved = F.col("target").isNotNull() & (F.col("halvings") >= best)
        current = proposed.withColumn("split", F.when(moved, F.col("target")).otherwise(F.col("split"))).drop(
            "target", "halvings"
        )
        score, totals = best_score, best_state
    return current


def best_moves(
    assigned: DataFrame, classes: int, ratios: Mapping[str, float] = settings.SPLIT_RATIOS, seed: int = 42
) -> DataFrame:
    """source_key, split, target, delta: the best move of every group by itself in the first round, and
    what it changes of the objective; target is null where staying is best."""
    totals, targets, weights = _goals(assigned, classes, ratios)
    moves = _best_moves(assigned, classes, list(ratios), totals, targets, weights, f"{seed}:0")
    return moves.select("source_key", "split", "target", "delta")


def _goals(assigned: DataFrame, classes: int, ratios: Mapping[str, float]) -> tuple:
    """(totals, targets, weights): per split what each measure sums up to and should, and how much
    a measure's squared relative deviation counts."""
    totals = _totals(assigned, classes, list(ratios))
    overall = [sum(totals[s][m] for s in ratios) for m in range(1 + 2 * classes)]
    targets = {s: [max(total * ratios[s], 1.0) for total in overall] for s in ratios}
    return totals, targets, [8.0] + [1.0] * classes + [4.0] * classes


def _measures(classes: int) -> list[Column]:
    return [
        F.col("size"),
        *(F.get("class_counts", i) for i in range(classes)),
        *(F.get("class_image_counts", i) for i in range(classes)),
    ]


def _totals(assigned: DataFrame, classes: int, names: list[str]) -> dict[str, list[float]]:
    rows = assigned.groupBy("split").agg(
        *(F.sum(c).alias(f"m{i}") for i, c in enumerate(_measures(classes)))
    )
    found = {row["split"]: row for row in rows.collect()}  # one row per split
    width = 1 + 2 * classes
    return {s: [float(found[s][f"m{i}"]) if s in found else 0.0 for i in range(width)] for s in names}


def _change(classes: int, total: list[float], target: list[float], weights: list[float], direction: int) -> Column:
    """What adding (+1) a group to a split, or taking it (-1), changes: a quadratic in its measures."""
    row = [c.cast("double") for c in _measures(classes)]
    square = [w / g**2 for w, g in zip(weights, target)]
    linear = [2.0 * direction * w * (t - g) / g**2 for w, t, g in zip(weights, total, target)]
    return sum((m * (m * a + b) for m, a, b in zip(row, square, linear)), F.lit(0.0))


def _best_moves(
    current: DataFrame,
    classes: int,
    names: list[str],
    totals: dict[str, list[float]],
    targets: dict[str, list[float]],
    weights: list[float],
    salt: str,
) -> DataFrame:
    """Add `delta`, what the best move changes, `target` (null when no move helps) and `halvings`, how
    often a seeded coin kept the group."""
    # columns of their own, so that every sum is worked out once
    changes = {f"_enter_{s}": _change(classes, totals[s], targets[s], weights, 1) for s in names}
    changes |= {f"_leave_{s}": _change(classes, totals[s], targets[s], weights, -1) for s in names}
    leaving = F.coalesce(*(F.when(F.col("split") == s, F.col(f"_leave_{s}")) for s in names))
    options = F.array(
        *(
            F.struct(
                F.when(F.col("split") != s, leaving + F.col(f"_enter_{s}")).otherwise(0.0).alias("delta"),
                F.lit(s).alias("split"),
            )
            for s in names
        )
    )
    best = F.array_min(options)
    coin = F.conv(F.substring(F.sha2(F.concat(F.lit(salt + ":"), "source_key"), 256), 1, 8), 16, 10)
    halvings = F.least(F.lit(24), F.floor(32 - F.log2(coin.cast("double") + 1.0))).cast("int")
    return current.withColumns(changes).withColumn("_best", best).select(
        *(F.col(c) for c in current.columns),
        F.col("_best.delta").alias("delta"),
        F.when(F.col("_best.delta") < -1e-12, F.col("_best.split")).alias("target"),
        halvings.alias("halvings"),
    )


def _batch_sums(proposed: DataFrame, classes: int) -> list:
    """Sums of the proposed moves by (halvings, from, to): at most 25 x 6 rows."""
    return (
        proposed.where(F.col("target").isNotNull())
        .groupBy("halvings", "split", "target")
        .agg(*(F.sum(c).cast("double").alias(f"m{i}") for i, c in enumerate(_measures(classes))))
        .collect()
    )
