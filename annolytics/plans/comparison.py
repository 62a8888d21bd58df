"""The comparison of runs as three SQL views: ranked_experiments, per_class_long and
comparison_headline, over experiment_metrics, per_class_metrics and comparison_context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolytics.operators.experiments import comparison_context, per_class_comparison, run_summary
from annolytics.session import cut_lineage
from annolytics.sources.artifacts import read_runs
from annolytics.sources.publish import publish

EXPERIMENT_COLUMNS = {
    "experiment": "run",
    "label": "label",
    "model": "model",
    "imgsz": "imgsz",
    "best_epoch": "best_epoch",
    "validation_map50_95": "map50_95",
    "validation_map50": "map50",
    "test_map50_95": "test_map50_95",
    "mean_latency_ms": "mean_latency_ms",
    "p95_latency_ms": "p95_latency_ms",
    "model_size_mib": "model_size_mib",
}

RANKED = "SELECT * FROM experiment_metrics ORDER BY validation_map50_95 DESC, experiment"

LONG = """
    SELECT class_order, class_name, side.experiment, side.ap50_95, side.delta
    FROM per_class_metrics
    LATERAL VIEW inline(array(
        named_struct('experiment', 'Baseline', 'ap50_95', baseline_ap50_95, 'delta', 0.0D),
        named_struct('experiment', 'Selected', 'ap50_95', selected_ap50_95, 'delta', delta_ap50_95)
    )) side AS experiment, ap50_95, delta
    ORDER BY class_order, experiment
"""

# The context and the pivoted classes are one row each; without class rows there is no headline.
HEADLINE = """
    WITH roles AS (
        SELECT role, experiment FROM comparison_context
        LATERAL VIEW inline(array(
            named_struct('role', 's', 'experiment', selected_experiment),
            named_struct('role', 'b', 'experiment', baseline_experiment)
        )) r AS role, experiment
    ),
    runs AS (
        SELECT
            max(struct(e.*)) FILTER (WHERE role = 's') AS s,
            max(struct(e.*)) FILTER (WHERE role = 'b') AS b
        FROM experiment_metrics e JOIN roles USING (experiment)
    ),
    classes AS (
        SELECT
            count(*) AS n,
            max(selected_ap50_95) FILTER (WHERE class_name = 'no_helmet') AS no_helmet_ap50_95,
            max(delta_ap50_95) FILTER (WHERE class_name = 'no_helmet') AS no_helmet_delta,
            max(selected_ap50_95) FILTER (WHERE class_name = 'no_vest') AS no_vest_ap50_95,
            max(delta_ap50_95) FILTER (WHERE class_name = 'no_vest') AS no_vest_delta
        FROM per_class_metrics
    )
    SELECT
        s.validation_map50_95 AS selected_validation_map50_95,
        s.validation_map50_95 - b.validation_map50_95 AS validation_delta,
        s.test_map50_95 AS selected_test_map50_95,
        s.test_map50_95 - b.test_map50_95 AS test_delta,
        no_helmet_ap50_95, no_helmet_delta, no_vest_ap50_95, no_vest_delta,
        s.mean_latency_ms AS mean_latency_ms
    FROM runs JOIN classes ON n > 0
"""


def comparison_views(summary: DataFrame, per_class: DataFrame) -> dict[str, DataFrame]:
    """Register the three tables as temporary views and return the three result tables.  `summary`
    comes from `run_summary` with test metrics and performance joined."""
    spark = summary.sparkSession
    context = comparison_context(summary)
    metrics = summary.select(*(F.col(c).alias(name) for name, c in EXPERIMENT_COLUMNS.items()))
    metrics.createOrReplaceTempView("experiment_metrics")
    per_class_comparison(context, per_class).createOrReplaceTempView("per_class_metrics")
    context.select("baseline_experiment", "selected_experiment").createOrReplaceTempView(
        "comparison_context"
    )
    return {
        "experiments": spark.sql(RANKED),
        "per_class": spark.sql(LONG),
        "headline": spark.sql(HEADLINE),
    }


def compare_runs(spark: SparkSession, runs: list[str], target: str) -> str:
    """Read some run folders, compare them and store the result below `target` as a new version: summary
    (a row a run), context, experiments, per_class and headline, all from one written summary."""
    tables = read_runs(spark, runs)
    optional = (tables[name] for name in ("test_metrics", "performance", "errors"))
    summary = cut_lineage(run_summary(tables["runs"], tables["resumes"], tables["epochs"], *optional))
    views = comparison_views(summary, cut_lineage(tables["per_class"]))
    return publish({"summary": summary, "context": comparison_context(summary), **views}, target)
