import json

import pytest

from annolytics.operators import experiments
from annolytics.plans.comparison import compare_runs, comparison_views
from annolytics.sources import artifacts
from annolytics.sources.publish import read_published


def write_run(tmp_path, name, maps, tested=True, resume=None, status="completed"):
    run = tmp_path / name
    (run / "test_evaluation").mkdir(parents=True)
    (run / "performance").mkdir()
    (run / "training_run.json").write_text(json.dumps({
        "config": {"model": f"weights/{name}.pt", "imgsz": 512, "epochs": 3}, "status": status,
        "started_at": "2024-01-01T00:00:00+00:00", "ended_at": "2024-01-01T01:00:00+00:00",
        "duration_seconds": 10.0, "completed_epochs": len(maps),
    }, indent=2))
    lines = ["epoch,   metrics/precision(B), metrics/recall(B), metrics/mAP50(B), metrics/mAP50-95(B)"]
    lines += [f"{i},  0.5, 0.6, 0.7, {m}" for i, m in enumerate(maps, 1)]
    (run / "results.csv").write_text("\n".join(lines) + "\n")
    if tested:
        per_class = [
            {"class_id": k, "class_name": c, "precision": 0, "recall": 0, "ap50": 0, "ap50_95": max(maps) - 0.1}
            for k, c in enumerate(("no_helmet", "no_vest"))
        ]
        (run / "test_evaluation/test_metrics.json").write_text(json.dumps({
            "metrics": {"precision": 0.1, "recall": 0.2, "map50": 0.3, "map50_95": max(maps) - 0.05},
            "test_images": 9, "per_class": per_class,
        }))
        (run / "error_analysis").mkdir()
        (run / "error_analysis/error_analysis.json").write_text(json.dumps({"image_counts": {"class_confusion": 3}}))
        (run / "performance/performance.json").write_text(json.dumps({
            "average_latency_ms": 8.5, "p50_latency_ms": 8, "p95_latency_ms": 12.25, "model_file_size_mb": 5.2,
            "samples": 100, "device": "cpu",
        }))
    if resume:
        (run / "resume_run.json").write_text(json.dumps(resume))
    return str(run)


def summary_of(tables):
    return experiments.run_summary(
        tables["runs"], tables["resumes"], tables["epochs"], tables["test_metrics"], tables["performance"],
        tables["errors"],
    )


def test_comparison_from_files(spark, tmp_path):
    runs = [
        write_run(tmp_path, "first", [0.3, 0.4]),
        write_run(tmp_path, "second", [0.5, 0.5, 0.2], resume={
            "status": "completed", "ended_at": "2024-01-02", "duration_seconds": 20.0, "completed_epochs": 3,
        }, status="interrupted"),
        write_run(tmp_path, "third", [0.5], tested=False, status="failed"),
    ]
    tables = artifacts.read_runs(spark, runs)
    rows = {r["run"]: r for r in summary_of(tables).collect()}
    assert rows["second"]["status"] == "completed" and rows["second"]["resumed"]
    assert rows["second"]["duration_seconds"] == 30.0 and rows["second"]["completed_epochs"] == 3
    assert rows["second"]["ended_at"] == "2024-01-02"
    assert rows["second"]["best_epoch"] == 1 and not rows["second"]["stopped_early"]
    assert rows["first"]["stopped_early"] and rows["first"]["label"] == "first / 512px / 3ep"
    assert rows["first"]["error_image_counts"] == {"class_confusion": 3}
    assert rows["first"]["mean_latency_ms"] == 8.5 and rows["third"]["device"] is None
    assert rows["third"]["test_map50_95"] is None and not rows["third"]["stopped_early"]

    context = experiments.comparison_context(summary_of(tables)).first()
    assert (context["baseline_experiment"], context["selected_experiment"]) == ("first", "second")
    assert context["validation_delta"] == pytest.approx(0.1)
    assert context["test_delta"] == pytest.approx(0.1)

    views = comparison_views(summary_of(tables), tables["per_class"])
    assert [r["experiment"] for r in views["experiments"].collect()] == ["second", "third", "first"]
    long = [(r["class_order"], r["class_name"], r["experiment"]) for r in views["per_class"].collect()]
    assert long == [
        (0, "no_helmet", "Baseline"), (0, "no_helmet", "Selected"),
        (1, "no_vest", "Baseline"), (1, "no_vest", "Selected"),
    ]
    headline = views["headline"].first()
    assert headline["no_helmet_delta"] == pytest.approx(0.1)
    assert headline["no_vest_ap50_95"] == pytest.approx(0.4)


def test_without_tests_there_is_no_headline(spark, tmp_path):
    runs = [write_run(tmp_path, n, [m], tested=False) for n, m in (("a", 0.1), ("b", 0.2))]
    tables = artifacts.read_runs(spark, runs)
    assert experiments.comparison_context(summary_of(tables)).first()["test_delta"] is None
    views = comparison_views(summary_of(tables), tables["per_class"])
    assert views["headline"].count() == views["per_class"].count() == 0


def test_broken_artifacts_are_errors(spark, tmp_path):
    run = write_run(tmp_path, "only", [0.4])
    tables = artifacts.read_runs(spark, [run])
    with pytest.raises(Exception, match="at least two runs"):
        experiments.comparison_context(summary_of(tables)).collect()
    (tmp_path / "only/results.csv").write_text("epoch,metrics/mAP50-95(B)\n")
    with pytest.raises(ValueError, match="empty"):
        artifacts.read_epochs(spark, [run])
    (tmp_path / "only/training_run.json").unlink()
    with pytest.raises(FileNotFoundError):
        artifacts.read_runs(spark, [run])


def test_attempts_are_numbered_by_start(spark):
    rows = [
        ("a", 1, "2024-01-03", "failed"), ("a", 2, "2024-01-01", "running"), ("a", 3, "2024-01-02", "completed"),
        ("b", 4, "2023-05-05", "interrupted"),
    ]
    df = spark.createDataFrame(rows, "run string, attempt_id long, started_at string, status string")
    df = df.withColumn("started_at", df.started_at.cast("timestamp"))
    found = {(r["attempt_id"], r["attempt"], r["outcome"]) for r in experiments.number_attempts(df).collect()}
    assert found == {(2, 1, "interrupted"), (1, 2, "failed"), (4, 1, "interrupted")}


def test_logs_with_headers_of_their_own_are_one_scan(spark, tmp_path):
    runs = [write_run(tmp_path, f"run +{i}%20ü", [0.1 * i]) for i in range(1, 7)]
    (tmp_path / "run +2%20ü/results.csv").write_bytes(
        b'  metrics/mAP50-95(B) ,"train, loss", recall , x,mAP50(B),epoch,precision\r\n\r\n0.5,"1,5",0.2,y,0.3, 4 ,0.1\r\n'
    )
    found = artifacts.read_epochs(spark, runs)
    assert {r["run"]: (r["epoch"], round(r["map50_95"], 9)) for r in found.collect()} == {
        "run +2%20ü": (4, 0.5), **{f"run +{i}%20ü": (1, round(0.1 * i, 9)) for i in (1, 3, 4, 5, 6)}
    }
    (row,) = [r for r in found.collect() if r["epoch"] == 4]
    assert tuple(row)[2:] == (0.1, 0.2, 0.3, 0.5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    (tmp_path / "run +3%20ü/results.csv").write_text("")
    (tmp_path / "run +5%20ü/results.csv").write_text("epoch,precision\n\n")
    with pytest.raises(ValueError, match=r"empty: run \+3%20ü, run \+5%20ü"):
        artifacts.read_epochs(spark, runs)
    (tmp_path / "run +1%20ü/results.csv").write_text("epoch,precision\n1,0.5\n")
    with pytest.raises(Exception, match="no metric column contains"):
        artifacts.read_epochs(spark, runs[:2]).collect()


def test_a_comparison_is_stored(spark, tmp_path):
    runs = [write_run(tmp_path, "first", [0.3, 0.4]), write_run(tmp_path, "second", [0.5])]
    target = str(tmp_path / "comparison")
    first = compare_runs(spark, runs, target)
    assert read_published(spark, target, "summary").count() == 2
    headline = read_published(spark, target, "headline").first()
    assert headline["no_helmet_delta"] == pytest.approx(0.1)
    assert read_published(spark, target, "experiments").count() == 2
    assert read_published(spark, target, "per_class").count() == 4
    assert read_published(spark, target, "context").first()["selected_experiment"] == "second"
    write_run(tmp_path, "third", [0.9])
    second = compare_runs(spark, [*runs, str(tmp_path / "third")], target)
    assert second != first and read_published(spark, target, "context").first()["selected_experiment"] == "third"


def test_runs_without_epochs_stay(spark):
    runs = spark.createDataFrame(
        [("a", 0, "m.pt", 64, 3, "completed", 5.0, None), ("b", 1, "m.pt", 64, 3, "interrupted", 5.0, 2)],
        "run string, position int, model string, imgsz int, target_epochs int, status string, duration_seconds double, completed_epochs long",
    )
    resumes = spark.createDataFrame(
        [("b", "completed", None, 3)], "run string, status string, duration_seconds double, completed_epochs long"
    )
    epochs = spark.createDataFrame(
        [("b", 1, 0.1, 0.2, 0.3, 0.4)], "run string, epoch int, precision double, recall double, map50 double, map50_95 double"
    )
    rows = {r["run"]: r for r in experiments.run_summary(runs, resumes, epochs).collect()}
    assert rows["a"]["best_epoch"] is None and rows["a"]["stopped_early"] is None
    assert rows["b"]["resumed"] and rows["b"]["status"] == "completed" and rows["b"]["duration_seconds"] == 5.0
