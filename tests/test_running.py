import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from annolytics.operators.metrics import latency_summary
from annolytics.operators.ranking import first_per_group, first_rows
from annolytics.operators.running import (
    LARGE,
    _below,
    exact_percentiles,
    hash_buckets,
    ordered_totals,
    running_totals,
    value_cuts,
)
from annolytics.sources.publish import write_report


def test_running_totals_equal_a_plain_window(spark):
    rng = random.Random(3)
    values = {rng.choice([-1, 1]) * 10 ** rng.uniform(-6, 6) for _ in range(400)} | {0.0}
    rows = [(rng.choice("aab"), v, rng.randrange(9)) for v in values]
    df = spark.createDataFrame(rows, "g string, v double, m long").repartition(7)
    found = ordered_totals(df, ["g"], F.col("v"), ["m"])
    plain = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    expected = df.withColumn("m_upto", F.sum("m").over(plain)).withColumn(
        "m_total", F.sum("m").over(Window.partitionBy("g"))
    )
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


CLOSE = {
    "within 1e-5 of 1,000": "1000 + id * 1e-10",
    "seconds of three hours": "1.7e9 + id % 10080 + id / 1e6",
    "many scales and signs": "(id % 2 * 2 - 1) * pow(10, id % 600 - 300) * (1 + id / 1e6)",
    "half of them far off": "CASE WHEN id % 2 = 0 THEN id / 1e12 ELSE id * 1e12 END",
}


@pytest.mark.parametrize("law", CLOSE)
def test_cuts_follow_the_data(spark, law):
    df = spark.range(0, 60_000, 1, 8).select(F.expr(CLOSE[law]).cast("double").alias("v"), F.lit("a").alias("g"))
    small = spark.range(LARGE).select(F.col("id").cast("double").alias("v"), F.lit("b").alias("g"))
    rows = df.unionByName(small)
    cuts = value_cuts(rows, ["g"], F.col("v"))
    assert [r["g"] for r in cuts.collect()] == ["a"]
    coarse, fine = _below(F.col("__steps"), F.col("__cuts"), F.col("v"))
    sizes = [r["count"] for r in df.join(cuts, "g").groupBy(coarse, fine).count().collect()]
    assert len(sizes) > 200 and max(sizes) < 700


def test_cut_groups_equal_a_plain_window(spark):
    rng = random.Random(8)
    odd = [None, None, float("nan"), float("inf"), float("-inf"), 0.0, -1e-310]
    values = [rng.gauss(1000, 1e-5) for _ in range(3 * LARGE)] + odd
    rows = [(None if rng.random() < 0.9 else "b", v, i, rng.randrange(9)) for i, v in enumerate(values + values[:50])]
    df = spark.createDataFrame(rows, "g string, v double, i long, m long").repartition(7)
    found = ordered_totals(df, ["g"], F.col("v"), ["m"], [F.col("i")])
    assert found.columns == ["g", "v", "i", "m", "m_upto", "m_total"]
    plain = Window.partitionBy("g").orderBy("v", "i").rowsBetween(Window.unboundedPreceding, 0)
    expected = df.withColumn("m_upto", F.sum("m").over(plain)).withColumn(
        "m_total", F.sum("m").over(Window.partitionBy("g"))
    )
    assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect()))


def test_hash_order_buckets(spark):
    df = spark.range(300).select(F.sha2(F.col("id").cast("string"), 256).alias("h"), F.lit(1).alias("n"))
    df = df.withColumn("g", F.lit(0))
    found = running_totals(df, ["g"], [F.col("h")], hash_buckets(F.col("h")), ["n"])
    assert [r["n_upto"] for r in found.orderBy("h").collect()] == list(range(1, 301))


def test_percentiles_interpolate(spark):
    numpy = pytest.importorskip("numpy")
    rng = random.Random(5)
    groups = {"a": [round(rng.expovariate(0.01), 1) for _ in range(501)], "b": [4.0], "c": [1.0, 2.0] * 40}
    rows = [(g, v) for g, found in groups.items() for v in found] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for row in exact_percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect():
        assert row["p50"] == pytest.approx(numpy.percentile(groups[row["g"]], 50))
        assert row["p95"] == pytest.approx(numpy.percentile(groups[row["g"]], 95))


def test_latency_summary_and_report_files(spark, tmp_path):
    rows = [("a", 1.0, 0.5), ("a", 3.0, 1.5), ("b", 7.0, None)]
    log = spark.createDataFrame(rows, "model string, ms double, pre double")
    found = {r["model"]: r for r in latency_summary(log, ["model"], "ms", ["pre"]).collect()}
    assert tuple(found["a"]) == ("a", 2, 2.0, 1.0, 2.0, pytest.approx(2.9))
    assert found["b"]["mean_pre"] is None and found["b"]["p95_ms"] == 7.0

    write_report(log, str(tmp_path / "csv"), "csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == log.columns and back.count() == 3
    write_report(log, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    with pytest.raises(Exception, match="exists"):
        write_report(log, str(tmp_path / "json"))


@pytest.mark.parametrize("limit", ["1000", "3"])
def test_first_per_group_with_and_without_the_built_in_limit(spark, limit):
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, limit)
    try:
        df = spark.range(200).select((F.col("id") % 3).alias("g"), (F.col("id") * 37 % 200).alias("v"))
        found = first_per_group(df, ["g"], ["v"], 10)
        rows = sorted((r["g"], r["rank"], r["v"]) for r in found.collect())
    finally:
        spark.conf.set(key, before)
    values = {g: sorted(i * 37 % 200 for i in range(200) if i % 3 == g)[:10] for g in range(3)}
    assert rows == [(g, n + 1, v) for g in range(3) for n, v in enumerate(values[g])]
    assert [r["v"] for r in first_rows(df, ["v"], 2).collect()] == [0, 1]
    with pytest.raises(ValueError):
        first_per_group(df, ["g"], ["v"], 0)
