"""Pairs of overlapping boxes without pairing everything inside an image.

Boxes are put on a grid whose cell size follows the size of the box (powers of 8).  Two boxes can
only reach an IoU of `t` when their sizes differ by at most 1/t and their centres lie within
(1-t)/(1+t) of their mean size, per axis.  So one side is stored once, in the cell of its centre at
its own level, and the other side looks into the few cells that such a partner could have.  The
equi-join on image, level and cell finds every pair exactly once; the exact IoU decides.  A crowded
image spreads over its cells instead of becoming one join key.  Images of at most FEW boxes a side are
joined as they are: their boxes move once, not once a cell, and stay together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolytics.functions.boxes import iou
from annolytics.session import cut_lineage

CORNERS = ("x1", "y1", "x2", "y2")
_STEP = 3.0  # a level is a factor of 2 ** 3
_SLACK = 1e-6
FEW = 64  # boxes of an image, on one side, that are compared with all others


def has_area(prefix: str = "") -> Column:
    """Only boxes with an area can have a positive IoU."""
    x1, y1, x2, y2 = (F.col(prefix + name) for name in CORNERS)
    return (x2 > x1) & (y2 > y1)


def _measured(df: DataFrame, prefix: str) -> DataFrame:
    """Add width, height and centre of the box."""
    x1, y1, x2, y2 = (F.col(prefix + name) for name in CORNERS)
    return df.where(has_area(prefix)).withColumns(
        {"__w": x2 - x1, "__h": y2 - y1, "__cx": (x1 + x2) / 2, "__cy": (y1 + y2) / 2}
    )


def _level(size: Column, slack: float = 0.0) -> Column:
    return _known(F.floor(F.log2(size) / _STEP + slack).cast("int"))


def _known(value: Column) -> Column:
    """Declare a grid number non-null, so that no null filter repeats its expression at the scan."""
    return F.coalesce(value, F.lit(0))


def _with_cell(df: DataFrame) -> DataFrame:
    return df.withColumn("__cell", F.pow(F.lit(2.0), (F.col("__level") + 1) * _STEP))


def _stored(df: DataFrame, prefix: str) -> DataFrame:
    leveled = _measured(df, prefix).withColumn("__level", _level(F.greatest("__w", "__h")))
    return _with_cell(leveled).withColumns(
        {
            "__gx": _known(F.floor(F.col("__cx") / F.col("__cell"))),
            "__gy": _known(F.floor(F.col("__cy") / F.col("__cell"))),
        }
    ).drop(*_HELPERS)


def _looking(df: DataFrame, prefix: str, min_iou: float, levels: str) -> DataFrame:
    size = F.col("__size")
    first = {
        "all": _level(size * min_iou, -_SLACK),
        "up": _level(size),
        "above": _level(size) + 1,
    }[levels]
    found = (
        _measured(df, prefix)
        .withColumn("__size", F.greatest("__w", "__h"))
        .withColumns({"__first": first, "__last": _level(size / min_iou, _SLACK)})
        .where(F.col("__last") >= F.col("__first"))
    )
    found = found.select(
        "*",
        F.posexplode_outer(_repeat(F.col("__last") - F.col("__first") + 1)).alias("__step", "__one"),
    ).withColumn("__level", _known(F.col("__first") + F.col("__step")))
    found = _with_cell(found)

    reach = (1.0 - min_iou) / (1.0 + min_iou) / 2.0 * (1.0 + _SLACK)
    cell = F.col("__cell")

    def far(centre: str, width: str) -> Column:
        partner = F.least(cell, F.col(width) / min_iou)
        return (F.col(width) + partner) * reach + (F.abs(F.col(centre)) + cell) * 1e-9

    found = found.withColumns({"__fx": far("__cx", "__w"), "__fy": far("__cy", "__h")}).withColumns(
        {
            f"__{axis}{end}": F.floor((F.col(f"__c{axis}") + sign * F.col(f"__f{axis}")) / cell)
            for axis in "xy"
            for end, sign in ((0, -1), (1, 1))
        }
    )
    found = found.withColumn("__wide", F.col("__x1") - F.col("__x0") + 1)
    cells = (F.col("__wide") * (F.col("__y1") - F.col("__y0") + 1)).cast("int")
    return (
        found.drop("__step", "__one")
        .select("*", F.posexplode_outer(_repeat(cells)).alias("__step", "__one"))
        .withColumns(
            {
                "__gx": _known(F.col("__x0") + F.col("__step") % F.col("__wide")),
                "__gy": _known(F.col("__y0") + F.floor(F.col("__step") / F.col("__wide"))),
            }
        )
        .drop(*_HELPERS)
    )


def _repeat(times: Column) -> Column:
    return F.array_repeat(F.lit(True), times)


_HELPERS = (
    "__w", "__h", "__cx", "__cy", "__size", "__first", "__last", "__step", "__one", "__cell",
    "__fx", "__fy", "__x0", "__x1", "__y0", "__y1", "__wide",
)


def crowded_images(image: str, *sides: DataFrame, unnamed: bool = False) -> DataFrame | None:
    """The images with more than FEW boxes on one of the sides, and null where `unnamed` and there is such a box; None
    when there are none."""
    found = None
    for boxes in sides:
        many = boxes.groupBy(image).count()
        much = F.col("count") > FEW
        many = many.where(much | F.col(image).isNull() if unnamed else much).select(image)
        found = many if found is None else found.union(many)
    found = cut_lineage(found.distinct())
    return None if found.isEmpty() else found


def overlapping_pairs(
    left: DataFrame, right: DataFrame, on: Sequence[str], min_iou: float, counted: Sequence[DataFrame] = ()
) -> DataFrame:
    """All pairs with equal `on` columns, the image first, and IoU >= `min_iou`, with an `iou` column.

    Both sides carry x1, y1, x2, y2; in the result, and in what callers filter on, every column that
    is not in `on` is prefixed with `l_` or `r_`.  Images are counted in the two sides, or in tables
    `counted` that have no fewer boxes of any image and are cheaper to read.
    """
    if not 0.0 < min_iou <= 1.0:
        raise ValueError("the IoU threshold must be in (0, 1]")
    on = list(on)
    crowded = crowded_images(on[0], *(counted or (left, right)))
    left = _prefixed(left, on, "l_")
    right = _prefixed(right, on, "r_")
    if crowded is None:
        pairs = _near_pairs(left, right, on)
    else:
        few = (side.join(crowded, on[0], "left_anti") for side in (left, right))
        many = (side.join(crowded, on[0], "left_semi") for side in (left, right))
        pairs = _near_pairs(*few, on).unionByName(_grid_pairs(*many, on, min_iou))
    overlap = iou(
        tuple(F.col("l_" + name) for name in CORNERS),
        tuple(F.col("r_" + name) for name in CORNERS),
    )
    return pairs.withColumn("iou", overlap).where(F.col("iou") >= min_iou)


def _near_pairs(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return _join(left.where(has_area("l_")), right.where(has_area("r_")), on)


def _grid_pairs(left: DataFrame, right: DataFrame, on: list[str], min_iou: float) -> DataFrame:
    keys = [*on, "__level", "__gx", "__gy"]
    if min_iou >= 0.3:
        pairs = _join(_looking(left, "l_", min_iou, "all"), _stored(right, "r_"), keys)
    else:
        # With a low threshold partners differ much in size: the smaller box of a pair looks for
        # the larger one, so that nobody has to search many small cells.
        pairs = _join(_looking(left, "l_", min_iou, "up"), _stored(right, "r_"), keys).unionByName(
            _join(_looking(right, "r_", min_iou, "above"), _stored(left, "l_"), keys)
        )
    return pairs.drop("__level", "__gx", "__gy")


def _join(looking: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """A sort-merge join: it spills, adaptive execution can split its skewed partitions, and the
    size estimate that would otherwise choose a broadcast knows nothing of the exploded rows."""
    return looking.hint("merge").join(stored, keys)


def _prefixed(df: DataFrame, on: list[str], prefix: str) -> DataFrame:
    return df.select(*on, *(F.col(c).alias(prefix + c) for c in df.columns if c not in on))
