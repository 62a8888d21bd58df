"""Rows that joins and windows must not lose or keep twice."""

import math
from datetime import datetime

from pyspark.sql import functions as F

from annolytics.operators import dedup, experiments, metrics


def test_one_path_in_two_splits_is_kept_once(spark):
    rows = [("d", "train", "/a.jpg", "/a.txt", 1, ["x"]), ("d", "val", "/a.jpg", "/a.txt", 1, ["x"])]
    records = spark.createDataFrame(
        rows, "digest string, split string, path string, label_path string, object_count long, output_lines array<string>"
    )
    kept = dedup.kept_records(dedup.with_winner(records)).collect()
    assert [r.split for r in kept] == ["train"]
    assert dedup.with_winner(records).columns == [*records.columns, "kept_image", "is_kept"]


def test_latency_keeps_groups_without_values_and_the_null_group(spark):
    rows = [("a", 1.0), ("a", 3.0), ("b", None), (None, 5.0), ("n", 1.0), ("n", math.nan), ("n", 3.0)]
    log = spark.createDataFrame(rows, "device string, ms double")
    found = {r.device: r for r in metrics.latency_summary(log, ["device"], "ms").collect()}
    assert set(found) == {"a", "b", None, "n"}
    assert found["a"].p50_ms == 2.0 and found[None].p95_ms == 5.0
    assert found["b"].samples == 0 and found["b"].p50_ms is None
    assert found["n"].p50_ms == 3.0 and math.isnan(found["n"].p95_ms)  # NaN sorts last


def test_attempts_without_a_start_come_first(spark):
    day = datetime(2024, 5, 1)
    rows = [("r", 1, day, "failed"), ("r", 2, None, "running"), (None, 3, day, "failed")]
    attempts = spark.createDataFrame(rows, "run string, attempt_id int, started_at timestamp, status string")
    found = experiments.number_attempts(attempts).collect()
    assert {(r.run, r.attempt_id): r.attempt for r in found} == {("r", 2): 1, ("r", 1): 2, (None, 3): 1}
