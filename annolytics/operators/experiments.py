"""Compare training runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolytics.functions.naming import experiment_label
from annolytics.functions.paths import file_stem
from annolytics.operators.running import ordered_totals

METRICS = ["precision", "recall", "map50", "map50_95"]


# A comma outside quotes.
_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
_LOGGED = {"epoch": "epoch", "precision": "precision", "recall": "recall", "map50": "mAP50(B)", "map50_95": "mAP50-95"}


def _fields(line: Column) -> Column:
    return F.transform(F.split(line, _COMMA), lambda f: F.trim(F.regexp_replace(F.trim(f), '^"|"$', "")))


def epoch_rows(logs: DataFrame) -> DataFrame:
    """`logs(run, text)`, whole CSV files, as run, epoch, precision, recall, map50, map50_95.

    Each file has its own header, in any order and padded with blanks: a column is the first whose name
    contains the metric's.  A file without one is an error; blank lines are left out.
    """
    lines = F.filter(F.split("text", r"\r\n|\n|\r"), lambda x: F.trim(x) != "")
    rows = logs.select("run", lines.alias("lines")).select(
        "run",
        _fields(F.get("lines", 0)).alias("header"),
        F.explode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("line"),
    )
    rows = rows.select("run", "header", _fields(F.col("line")).alias("fields"))

    def logged(pattern: str) -> Column:
        place = F.array_position(F.transform("header", lambda h: F.contains(h, F.lit(pattern))), True)
        missing = F.raise_error(F.concat(F.lit(f"no metric column contains '{pattern}': "), F.col("run")))
        return F.when(place == 0, missing.cast("string")).otherwise(F.get("fields", (place - 1).cast("int"))).cast("double")

    values = {name: logged(pattern) for name, pattern in _LOGGED.items()}
    values["epoch"] = values["epoch"].cast("int")
    return rows.select("run", *(column.alias(name) for name, column in values.items()))


def best_epochs(epochs: DataFrame) -> DataFrame:
    """Per run: the epoch with the highest map50_95 (the earliest on ties), its metrics, and the
    number of logged epochs.  Every task reduces a run to one row before the shuffle."""
    best = F.max(F.struct("map50_95", (-F.col("epoch")).alias("e"), "precision", "recall", "map50"))
    return epochs.groupBy("run").agg(best.alias("b"), F.count("*").alias("completed_epochs")).select(
        "run",
        (-F.col("b.e")).alias("best_epoch"),
        "completed_epochs",
        *(F.col(f"b.{m}").alias(m) for m in METRICS),
    )


def merge_resumes(runs: DataFrame, resumes: DataFrame) -> DataFrame:
    """A completed resume takes over status, end and epochs of its run, and adds its duration."""
    finished = resumes.where(F.col("status") == "completed").select(
        "run",
        F.lit(True).alias("__resumed"),
        F.col("duration_seconds").alias("__more"),
        F.col("completed_epochs").alias("__epochs"),
        *([F.col("ended_at").alias("__ended")] if "ended_at" in resumes.columns else []),
    )
    joined = runs.join(finished, "run", "left")
    resumed = F.col("__resumed").isNotNull()

    def either(then: Column, otherwise: str) -> Column:
        return F.when(resumed, then).otherwise(F.col(otherwise))

    replaced = {
        "status": either(F.lit("completed"), "status"),
        "duration_seconds": either(
            F.col("duration_seconds") + F.coalesce("__more", F.lit(0)), "duration_seconds"
        ),
        "completed_epochs": either(F.col("__epochs"), "completed_epochs"),
        "resumed": resumed,
    }
    if "__ended" in joined.columns:
        replaced["ended_at"] = either(F.col("__ended"), "ended_at")
    return joined.withColumns(replaced).drop("__resumed", "__more", "__epochs", "__ended")


def run_summary(
    runs: DataFrame,
    resumes: DataFrame,
    epochs: DataFrame,
    test_metrics: DataFrame | None = None,
    performance: DataFrame | None = None,
    errors: DataFrame | None = None,
) -> DataFrame:
    """One row per run.  `runs`: run, position, model, imgsz, target_epochs, status,
    duration_seconds, completed_epochs.  Test metrics (run, test_*), performance and error counts are
    optional artifacts: runs without them get nulls, and so do runs without a logged epoch."""
    best = best_epochs(epochs).withColumnRenamed("completed_epochs", "logged_epochs")
    summary = merge_resumes(runs, resumes).join(best, "run", "left")
    epochs_done = F.coalesce("completed_epochs", "logged_epochs")
    early = (F.col("status") == "completed") & (epochs_done < F.col("target_epochs"))
    summary = summary.withColumns(
        {
            "label": experiment_label(F.col("model"), F.col("imgsz"), F.col("target_epochs")),
            "model": file_stem(F.col("model")),
            "stopped_early": early,
        }
    )
    for optional in (test_metrics, performance, errors):
        if optional is not None:
            summary = summary.join(optional, "run", "left")
    return summary


def comparison_context(summary: DataFrame) -> DataFrame:
    """One row: the baseline (first run), the selected run (highest map50_95, first on ties), their
    metrics and deltas.  The test delta is null unless both runs were tested."""
    first = F.min(F.struct("position", "run", "map50_95", "test_map50_95"))
    top = F.max(F.struct("map50_95", (-F.col("position")).alias("p"), "run", "test_map50_95"))
    found = summary.agg(first.alias("b"), top.alias("s"), F.count("*").alias("n"))
    enough = F.when(F.col("n") < 2, F.raise_error(F.lit("at least two runs are needed"))).otherwise(
        F.col("b.run")
    )
    return found.select(
        enough.alias("baseline_experiment"),
        F.col("s.run").alias("selected_experiment"),
        F.col("s.map50_95").alias("selected_map50_95"),
        (F.col("s.map50_95") - F.col("b.map50_95")).alias("validation_delta"),
        (F.col("s.test_map50_95") - F.col("b.test_map50_95")).alias("test_delta"),
    )


def per_class_comparison(context: DataFrame, per_class: DataFrame) -> DataFrame:
    """class_order, class_name, baseline and selected AP and their delta, for classes both runs have.
    `per_class`: run, class_order, class_name, ap50_95.  Two rows name the runs, so they are broadcast
    and the class table is filtered where it is read."""
    roles = context.select(
        F.inline(
            F.array(
                F.struct(F.lit("baseline").alias("role"), F.col("baseline_experiment").alias("run")),
                F.struct(F.lit("selected").alias("role"), F.col("selected_experiment").alias("run")),
            )
        )
    )
    of_both = per_class.join(F.broadcast(roles), "run")
    is_baseline, is_selected = F.col("role") == "baseline", F.col("role") == "selected"
    sides = of_both.groupBy("class_name").agg(
        F.max(F.when(is_selected, F.col("class_order"))).alias("class_order"),
        F.max(F.when(is_baseline, F.col("ap50_95"))).alias("baseline_ap50_95"),
        F.max(F.when(is_selected, F.col("ap50_95"))).alias("selected_ap50_95"),
    )
    return sides.where("baseline_ap50_95 is not null and selected_ap50_95 is not null").select(
        "class_order",
        "class_name",
        "baseline_ap50_95",
        "selected_ap50_95",
        (F.col("selected_ap50_95") - F.col("baseline_ap50_95")).alias("delta_ap50_95"),
    )


def number_attempts(attempts: DataFrame) -> DataFrame:
    """Unfinished attempts of each run numbered by start: adds `attempt` and `outcome` (`failed` or
    `interrupted`).  `attempts`: run, attempt_id, started_at (timestamp), status."""
    unfinished = attempts.where(F.col("status") != "completed").withColumn("__one", F.lit(1))
    outcome = F.when(F.col("status") == "failed", "failed").otherwise("interrupted")
    started = F.unix_micros(F.col("started_at").cast("timestamp"))
    numbered = ordered_totals(unfinished, ["run"], started, ["__one"], [F.col("attempt_id")])
    return (
        numbered.withColumn("outcome", outcome)
        .withColumnRenamed("__one_upto", "attempt")
        .drop("__one", "__one_total")
    )
