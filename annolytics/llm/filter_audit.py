"""How five filters interact, over every order in which they can be applied.

A document's failures are a set of filters, a mask.  Orders are numbered by their Lehmer rank, which is
their lexicographic place.  Fixing a prefix of an order fixes an interval of ranks, so for one mask and
one step "removed here" holds on a few intervals: those of prefixes that end in a failing filter and
have none before.  Each (part, mask) adds its counts at the interval's start and takes them away at its
end; a prefix sum over the 120 ranks then gives what every order removes at every step.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annolytics.llm.common import whole_text

FILTERS = "ABCDE"
LEAST_WORDS = 100
LEAST_DISTINCT = 80  # per cent of words
MOST_CAPITALS = 10  # per cent of code points
SYMBOLS = "[#$%&*|]"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACES = r"[\x20\x09-\x0D]+"


def orders() -> list[str]:
    """All orders, by Lehmer rank."""
    return ["".join(p) for p in permutations(FILTERS)]


def intervals(mask: int) -> Iterator[tuple[int, int, int]]:
    """(step, start, stop): ranks of the orders that remove a document of this mask at this step (from 1)."""
    n = len(FILTERS)

    def below(step: int, start: int, free: list[int]) -> Iterator[tuple[int, int, int]]:
        for place, filter_ in enumerate(free):
            width = factorial(n - step)
            at = start + place * width
            if mask >> filter_ & 1:
                yield step, at, at + width
            else:
                yield from below(step + 1, at, free[:place] + free[place + 1 :])

    yield from below(1, 0, list(range(n)))


# --- masks ----------------------------------------------------------------------------------------


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, _SPACES), lambda w: w != "")
    facts = F.struct(
        F.size(words).cast("bigint").alias("words"),
        F.size(F.array_distinct(words)).cast("bigint").alias("distinct"),
        F.length(text).cast("bigint").alias("points"),
        (F.length(text) - F.length(F.translate(text, _CAPITALS, ""))).cast("bigint").alias("capitals"),
        text.rlike(SYMBOLS).alias("symbols"),
    )

    def bits(f: Column) -> Column:
        fails = [
            f["words"] < LEAST_WORDS,
            f["distinct"] * 100 < f["words"] * LEAST_DISTINCT,
            f["capitals"] * 100 > f["points"] * MOST_CAPITALS,
            f["symbols"],
        ]
        return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails)), F.lit(0))

    # the facts are worked out once, then looked at by several conditions
    return F.get(F.transform(F.array(facts), bits), 0)


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, total, good, toxic): at most 32 rows a part.

    Only digests, ids and masks leave the scan.  Rows alike are counted before they move; rows of one
    text, of which A to D are the same, are counted before the smallest id of the text is sought.
    """
    text = whole_text()
    rows = (
        docs.select(
            "doc_id",
            F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
            F.sha2(text.cast("binary"), 256).alias("digest"),
            text_mask(text).alias("mask"),
        )
        .groupBy("doc_id", "part", "digest", "mask")
        .agg(F.count("*").alias("n"))
    )
    marks = (
        labels.filter("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(
            F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
            F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
        )
    )
    marked = rows.join(marks, "doc_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}
    )
    # ids without null: a null id is smaller than no other, and none is smaller than it
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    alike = marked.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(named["n"]).alias("named"), F.min(named).alias("first")
    )
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))  # a few rows a text
    first = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    copies = F.coalesce(F.col("named") - first, F.lit(0))
    split = alike.withColumn("least", least).withColumn("copies", copies)
    late = 1 << FILTERS.index("E")
    return (
        split.select(
            "part",
            "good",
            "toxic",
            F.explode(
                F.array(
                    F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("copies")).alias("n")),
                    F.struct((F.col("mask") + late).alias("mask"), F.col("copies").alias("n")),
                )
            ).alias("m"),
        )
        .groupBy("part", F.col("m.mask").alias("mask"))
        .agg(
            F.sum("m.n").alias("total"),
            F.sum(F.when(F.col("good"), F.col("m.n")).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("toxic"), F.col("m.n")).otherwise(0)).alias("toxic"),
        )
    )


# --- orders ---------------------------------------------------------------------------------------


def _plan(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(mask, step, rank, sign): the ends of all intervals; (cell, step, rank, filter_order, letter, place):
    the 600 places of a filter in an order."""
    masks = 1 << len(FILTERS)
    ends = [
        (mask, step, rank, sign)
        for mask in range(masks)
        for step, start, stop in intervals(mask)
        for rank, sign in ((start, 1), (stop, -1))
    ]
    cells = [
        (rank * len(FILTERS) + i, i + 1, rank, order, letter, FILTERS.index(letter))
        for rank, order in enumerate(orders())
        for i, letter in enumerate(order)
    ]
    return (
        spark.createDataFrame(ends, "mask int, step int, rank int, sign int"),
        spark.createDataFrame(cells, "cell int, step int, rank int, filter_order string, letter string, place int"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (each lang; null is the empty string), filter order and step.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley.  A null text is empty; long texts are read whole; a null id is never a copy and has none;
    rows of one id and text are no copies of each other; a document is good (toxic) if any label row
    of its id says so; labels without a document and other columns are ignored; without documents there are no rows.
    """
    spark = docs.sparkSession
    counts = mask_counts(docs, labels)
    ends, cells = _plan(spark)
    measures = ["total", "good", "toxic"]
    # the difference arrays: at most 32 masks meet in a cell
    steps = (
        counts.join(F.broadcast(ends), "mask")
        .groupBy("part", "step", "rank")
        .agg(*(F.sum(F.col(c) * F.col("sign")).alias(c) for c in measures))
    )
    fails = counts.groupBy("part").agg(
        F.sum("total").alias("documents"),
        F.array(
            *(
                F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("total")).otherwise(0))
                for i in range(len(FILTERS))
            )
        ).alias("fails"),
        F.array(
            *(F.sum(F.when(F.col("mask") == 1 << i, F.col("total")).otherwise(0)) for i in range(len(FILTERS)))
        ).alias("alone"),
    )
    every = F.sequence(F.lit(0), F.lit(factorial(len(FILTERS)) * len(FILTERS) - 1))
    grid = fails.withColumn("cell", F.explode(every)).join(F.broadcast(cells), "cell")
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    summed = grid.join(steps, ["part", "step", "rank"], "left").withColumns(
        {f"{c}_here": F.sum(F.coalesce(c, F.lit(0))).over(along) for c in measures}
    )
    order = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    letter = Window.partitionBy("part", "letter")
    fails_here, alone_here = F.get("fails", "place"), F.get("alone", "place")
    return summed.select(
        "part",
        "filter_order",
        "step",
        (F.col("documents") - F.sum("total_here").over(order)).alias("kept"),
        F.col("total_here").alias("removed"),
        (fails_here - F.col("total_here")).alias("redundant"),
        alone_here.alias("unique_fails"),
        F.col("good_here").alias("good_lost"),
        F.col("toxic_here").alias("toxic_lost"),
        F.sum("total_here").over(letter).alias("shapley"),
    )
