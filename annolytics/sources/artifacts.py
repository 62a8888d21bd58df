"""Run artifacts: JSON documents and CSV training logs below one folder per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolytics.operators.experiments import epoch_rows
from annolytics.sources.storage import file_status

_LATENCY = (
    "average_latency_ms double, p50_latency_ms double, p95_latency_ms double, "
    "model_file_size_mb double, samples long, device string"
)
_TRAINING = (
    "config struct<model:string,imgsz:int,epochs:int>, status string, started_at string, "
    "ended_at string, duration_seconds double, completed_epochs long"
)
_RESUME = "status string, ended_at string, duration_seconds double, completed_epochs long"
_METRICS = (
    "metrics struct<precision:double,recall:double,map50:double,map50_95:double>, test_images long, "
    "per_class array<struct<class_id:int,class_name:string,precision:double,recall:double,"
    "ap50:double,ap50_95:double>>"
)
_ERRORS = "image_counts map<string,long>"


def read_json(
    spark: SparkSession, runs: list[str], relative: str, schema: str, required: bool
) -> DataFrame:
    """One row per run that has the document `<run>/<relative>`, with the run's folder name as `run`.
    A missing required document is an error; a missing optional one is simply no row."""
    found = []
    for run in runs:
        path = f"{run.rstrip('/')}/{relative}"
        if file_status(spark, path) == "file":
            found.append(path)
        elif required:
            raise FileNotFoundError(f"required run artifact does not exist: {path}")
    fields = T.StructType.fromDDL(schema)
    if not found:
        return spark.createDataFrame([], T.StructType([T.StructField("run", T.StringType()), *fields.fields]))
    depth = relative.count("/") + 2
    run = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -depth)
    documents = spark.read.schema(fields).option("multiLine", "true").json(found)
    return documents.select(run.alias("run"), *fields.names)


def _folder_name(run: str) -> str:
    return run.rstrip("/").rsplit("/", 1)[-1]


def read_epochs(spark: SparkSession, runs: list[str], name: str = "results.csv") -> DataFrame:
    """run, epoch, precision, recall, map50, map50_95 of every run's log, all read in one scan; runs
    whose log is empty are an error.  A file is one row, so that every log can have a header of its own."""
    files = spark.read.text([f"{run.rstrip('/')}/{name}" for run in runs], wholetext=True)
    run = F.url_decode(F.replace(F.element_at(F.split("_metadata.file_path", "/"), -2), F.lit("+"), F.lit("%2B")))
    epochs = epoch_rows(files.select(run.alias("run"), F.col("value").alias("text")))
    listed = spark.createDataFrame([(_folder_name(r),) for r in runs], "run string")
    empty = listed.join(epochs.select("run"), "run", "left_anti").orderBy("run").limit(10).collect()
    if empty:
        raise ValueError(f"training results are empty: {', '.join(row.run for row in empty)}")
    return epochs


def read_runs(spark: SparkSession, runs: list[str]) -> dict[str, DataFrame]:
    """The tables the comparison works on: runs, resumes, epochs, test_metrics, per_class,
    performance, errors, in the given order of run folders."""
    order = spark.createDataFrame(
        [(_folder_name(run), i) for i, run in enumerate(runs)],
        "run string, position int",
    )
    training = read_json(spark, runs, "training_run.json", _TRAINING, required=True)
    tests = read_json(spark, runs, "test_evaluation/test_metrics.json", _METRICS, required=False)
    performance = read_json(spark, runs, "performance/performance.json", _LATENCY, required=False)
    errors = read_json(spark, runs, "error_analysis/error_analysis.json", _ERRORS, required=False)
    return {
        "errors": errors.withColumnRenamed("image_counts", "error_image_counts"),
        "runs": training.join(order, "run").select(
            "run",
            "position",
            F.col("config.model").alias("model"),
            F.col("config.imgsz").alias("imgsz"),
            F.col("config.epochs").alias("target_epochs"),
            "status",
            "started_at",
            "ended_at",
            "duration_seconds",
            "completed_epochs",
        ),
        "resumes": read_json(spark, runs, "resume_run.json", _RESUME, required=False),
        "epochs": read_epochs(spark, runs),
        "test_metrics": tests.select(
            "run",
            *(F.col(f"metrics.{m}").alias(f"test_{m}") for m in ("precision", "recall", "map50", "map50_95")),
            "test_images",
        ),
        "per_class": tests.select("run", F.posexplode("per_class").alias("class_order", "c")).select(
            "run", "class_order", "c.class_name", "c.ap50_95"
        ),
        "performance": performance.select(
            "run",
            F.col("average_latency_ms").alias("mean_latency_ms"),
            "p50_latency_ms",
            "p95_latency_ms",
            F.col("model_file_size_mb").alias("model_size_mib"),
            "samples",
            "device",
        ),
    }
