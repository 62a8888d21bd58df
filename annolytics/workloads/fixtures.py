"""Annotated-dataset tables derived from the driver's parquet tables, whole tables throughout.

Every table is a plain projection (or an explode) of one driver table, so both this module and the
SQL in `oracle.py` build identical rows, and the work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolytics import settings
from annolytics.taxonomy import Taxonomy

SOURCE_CLASSES = tuple(sorted({*settings.CLASS_SYNONYMS, *settings.REMOVED_SOURCE_CLASSES}))
SOURCE = Taxonomy.of(SOURCE_CLASSES)
TARGET = Taxonomy.of(settings.TARGET_CLASSES)
FINAL = Taxonomy.of(settings.FINAL_CLASSES)
ROOT = "/ds"
SPLITS = ("train", "val", "test")

# --- expressions that mean the same in Spark SQL and in DuckDB ------------------------------------

SPLIT = (
    "CASE WHEN (doc_id + floor(doc_id / 20)) % 10 < 7 THEN 'train' "
    "WHEN (doc_id + floor(doc_id / 20)) % 10 < 9 THEN 'val' ELSE 'test' END"
)
MISSING_LABEL = "n_chars < 60"
EMPTY_LABEL = "n_chars BETWEEN 60 AND 199"
UNDECODABLE_LABEL = "n_chars BETWEEN 200 AND 299"
MISSING_IMAGE = "n_chars BETWEEN 9000 AND 9999"
UNREADABLE_IMAGE = "n_chars BETWEEN 8000 AND 8999"
SEED = "CASE WHEN lang = 'en' THEN 0 ELSE doc_id END"


def two(expression: str) -> str:
    return f"lpad('' || ({expression}), 2, '0')"


def label_line(a: str) -> str:
    """A line for the source taxonomy, now and then a broken one; two blanks follow the class."""
    tail = f"' 0.50 0.' || {two(f'10 + {a} % 20')} || ' 0.20'"
    return (
        f"CASE WHEN {a} % 47 = 0 THEN '1 0.50 0.50 0.20'"
        f" WHEN {a} % 53 = 0 THEN 'x 0.50' || {tail}"
        f" WHEN {a} % 59 = 0 THEN '99 0.50' || {tail}"
        f" WHEN {a} % 61 = 0 THEN '3 abc' || {tail}"
        f" WHEN {a} % 67 = 0 THEN '4 nan' || {tail}"
        f" WHEN {a} % 71 = 0 THEN '5 1d' || {tail}"
        f" WHEN {a} % 73 = 0 THEN '6 1.20' || {tail}"
        f" WHEN {a} % 79 = 0 THEN '7 0.50 0.50 0.00 0.20'"
        f" ELSE ({a} % 16) || '  0.' || {two(f'20 + {a} * 3 % 60')} || ' 0.' || {two(f'5 + {a} * 11 % 90')}"
        f" || ' 0.' || {two(f'1 + {a} * 5 % 38')} || ' 0.' || {two(f'1 + {a} * 7 % 40')} END"
    )


def clean_line(a: str) -> str:
    """A valid line for the nine-class taxonomy; the last two classes are removed by a freeze."""
    return (
        f"({a} % 9) || ' 0.' || {two(f'20 + {a} * 3 % 60')} || ' 0.' || {two(f'20 + {a} * 11 % 60')}"
        f" || ' 0.' || {two(f'1 + {a} * 5 % 38')} || ' 0.' || {two(f'1 + {a} * 7 % 38')}"
    )


BOX_W, BOX_H = "(l_quantity / 100)", "((l_suppkey % 40 + 1) / 100e0)"
BOX_U, BOX_V = "((l_partkey % 101) / 100e0)", "((l_suppkey % 97) / 100e0)"
BOX_INDEX = (
    "(l_linenumber * 100 + CAST(l_quantity AS BIGINT)) * 10000000000000000 "
    "+ l_suppkey * 1000000000 + l_partkey"
)
SHIFT = f"(CASE WHEN l_suppkey % 10 = 0 THEN 0.8e0 ELSE l_tax * 2 END * {BOX_W})"
PREDICTED_CLASS = "(l_partkey % 7 + CASE WHEN l_suppkey % 13 = 0 THEN 1 ELSE 0 END) % 7"
CONFIDENCE = "((l_partkey * 31 + l_suppkey * 17) % 1000) / 1000e0"
TRUTH = {
    "image_id": "l_orderkey",
    "idx": BOX_INDEX,
    "class_id": "l_partkey % 7",
    "x1": f"{BOX_U} * (1 - {BOX_W}) * 640",
    "y1": f"{BOX_V} * (1 - {BOX_H}) * 640",
    "x2": f"({BOX_U} * (1 - {BOX_W}) + {BOX_W}) * 640",
    "y2": f"({BOX_V} * (1 - {BOX_H}) + {BOX_H}) * 640",
    "width": "640",
    "height": "640",
}
PREDICTIONS = {
    "image_id": "l_orderkey",
    "idx": BOX_INDEX,
    "class_id": PREDICTED_CLASS,
    "x1": f"({BOX_U} * (1 - {BOX_W}) + {SHIFT}) * 640",
    "y1": f"{BOX_V} * (1 - {BOX_H}) * 640",
    "x2": f"({BOX_U} * (1 - {BOX_W}) + {SHIFT} + {BOX_W}) * 640",
    "y2": f"({BOX_V} * (1 - {BOX_H}) + {BOX_H}) * 640",
    "conf": CONFIDENCE,
}
WIDTH, HEIGHT = "(320 + 16 * (doc_id % 41))", "(240 + 16 * (doc_id % 29))"
# From the boxes of label lines: shifted, some given the next class.
LABEL_SHIFT = "((image_id + idx) % 5 * 0.15e0 * (x2 - x1))"
LABEL_PREDICTIONS = {
    "image_id": "image_id",
    "idx": "idx",
    "class_id": "(class_id + CASE WHEN (image_id + idx) % 11 = 0 THEN 1 ELSE 0 END) % 9",
    "x1": f"x1 + {LABEL_SHIFT}",
    "y1": "y1",
    "x2": f"x2 + {LABEL_SHIFT}",
    "y2": "y2",
    "conf": "((image_id * 31 + idx * 17) % 1000) / 1000e0",
}
EPOCHS = {
    "run": "'run_' || o_custkey",
    "epoch": "o_orderkey",
    "precision": "(o_orderkey * 7919 % 1000) / 1000e0",
    "recall": "(o_orderkey * 104729 % 1000) / 1000e0",
    "map50": "(o_orderkey * 1299709 % 1000) / 1000e0",
    "map50_95": "(o_orderkey * 15485863 % 1000) / 1000e0",
}
RUNS = {
    "run": "'run_' || c_custkey",
    "position": "c_custkey",
    "model": "'weights/' || lower(c_mktsegment) || '.pt'",
    "imgsz": "320 + 32 * c_nationkey",
    "target_epochs": "5 + c_custkey % 10",
    "status": "CASE WHEN c_nationkey < 18 THEN 'completed' WHEN c_nationkey < 22 THEN 'interrupted' ELSE 'failed' END",
    "duration_seconds": "abs(c_acctbal)",
    "completed_epochs": "CASE WHEN c_nationkey < 18 THEN 4 + c_custkey % 12 END",
}
RESUMES = {
    "run": "'run_' || c_custkey",
    "status": "CASE WHEN c_nationkey >= 18 AND c_acctbal > 2000 THEN 'completed' ELSE 'failed' END",
    "duration_seconds": "c_nationkey * 10e0",
    "completed_epochs": "5 + c_custkey % 10",
}
TESTED = "c_acctbal > 0"
TEST_METRICS = {
    "run": "'run_' || c_custkey",
    "test_map50_95": "(c_custkey * 7907 % 1000) / 1000e0",
}
CLASS_AP = "((c_custkey * 131 + class_order * 7919) % 1000) / 1000e0"
MEASURED = "c_mktsegment <> 'MACHINERY'"
PERFORMANCE = {
    "run": "'run_' || c_custkey",
    "mean_latency_ms": "(c_custkey % 400) / 10e0",
    "p95_latency_ms": "(c_custkey % 700) / 10e0",
    "model_size_mib": "5e0 + c_nationkey",
}

# --- Spark tables ---------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read where it lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*(F.expr(sql).alias(name) for name, sql in columns.items()))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stem = (
        f"source || '_g' || CAST((doc_id - doc_id % 40) / 40 AS BIGINT) || CASE WHEN doc_id % 5 = 0 "
        "THEN '_' || doc_id ELSE '.rf.' || substr(sha2(text, 256), 1, 8) || '_' || doc_id END"
    )
    return docs.withColumns({"split": F.expr(SPLIT), "stem": F.expr(stem)})


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, width, height, split, path, content: one image per document."""
    body = F.encode("text", "utf-8")
    header = F.unhex(F.lit("FFD8FFE0"))
    return _documents(spark, sf_dir).select(
        F.col("doc_id").alias("image_id"),
        F.lit(640).alias("width"),
        F.expr("CASE WHEN doc_id % 2 = 0 THEN 480 ELSE 640 END").alias("height"),
        "split",
        F.expr("'/ds/' || split || '/images/' || stem || '.jpg'").alias("path"),
        F.when(F.expr(MISSING_IMAGE), None)
        .when(F.expr(UNREADABLE_IMAGE), body)
        .otherwise(F.concat(header, body))
        .alias("content"),
    )


def _label_text(line) -> str:
    a = f"(length(x) * 7 + (i + 1) * 13 + {SEED})"
    return (
        "array_join(transform(split(text, '\\n'), (x, i) -> "
        f"CASE WHEN length(x) = 0 THEN '' ELSE {line(a)} END), '\\n')"
    )


def label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label_path, content: a label line per text line; some files absent, empty or not UTF-8."""
    text = F.encode(F.expr(_label_text(label_line)), "utf-8")
    return (
        _documents(spark, sf_dir)
        .where(~F.expr(MISSING_LABEL))
        .select(
            F.expr("'/ds/' || split || '/labels/' || stem || '.txt'").alias("label_path"),
            F.when(F.expr(EMPTY_LABEL), F.encode(F.lit(""), "utf-8"))
            .when(F.expr(UNDECODABLE_LABEL), F.concat(text, F.unhex(F.lit("80"))))
            .otherwise(text)
            .alias("content"),
        )
    )


def clean_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same images, all present, for jobs that require a clean dataset."""
    return _documents(spark, sf_dir).select(
        F.col("doc_id").alias("image_id"),
        "split",
        F.expr("'/ds/' || split || '/images/' || stem || '.jpg'").alias("path"),
        F.encode("text", "utf-8").alias("content"),
    )


def clean_label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select(
        F.expr("'/ds/' || split || '/labels/' || stem || '.txt'").alias("label_path"),
        F.encode(F.expr(_label_text(clean_line)), "utf-8").alias("content"),
    )


def sized_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean images with headers that state a size: PNG for even documents, JPEG with up to 99 comments
    before the frame for odd ones."""
    png = (
        f"unhex('89504E470D0A1A0A0000000D49484452' || lpad(hex({WIDTH}), 8, '0') || lpad(hex({HEIGHT}), 8, '0') || '0802000000')"
    )
    jpeg = (
        "unhex('FFD8FFE0' || lpad(hex(2 + n_chars % 50), 4, '0') || repeat('FF', CAST(n_chars % 50 AS INT)) "
        "|| repeat('FFFE0004C0C0', CAST(doc_id % 100 AS INT)) "
        f"|| 'FFC0001108' || lpad(hex({HEIGHT}), 4, '0') || lpad(hex({WIDTH}), 4, '0') || '03')"
    )
    header = F.expr(f"CASE WHEN doc_id % 2 = 0 THEN {png} ELSE {jpeg} END")
    return _documents(spark, sf_dir).select(
        F.col("doc_id").alias("image_id"),
        "split",
        F.expr("'/ds/' || split || '/images/' || stem || '.jpg'").alias("path"),
        F.concat(header, F.encode("text", "utf-8")).alias("content"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(table(spark, sf_dir, "lineitem"), TRUTH)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(table(spark, sf_dir, "lineitem"), PREDICTIONS)


def _detections() -> str:
    names = ", ".join(f"'{name}'" for name in settings.FINAL_CLASSES)
    return (
        "transform(filter(sequence(0, 3), i -> i < event_id % 4), i -> named_struct("
        "'class_id', (event_id + i) % 7, "
        f"'class_name', element_at(array({names}), CAST((event_id + i) % 7 + 1 AS INT)), "
        "'confidence', ((event_id * 31 + i * 17) % 1000) / 1000e0))"
    )


def frames_from(events: DataFrame) -> DataFrame:
    """session_id, frame, ts, detections from event rows, batch or streaming."""
    return events.select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("frame"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.expr(_detections()).alias("detections"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_from(table(spark, sf_dir, "events"))


BATCHES = 4
DELAY = "30 minutes"


def arrivals(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The events in `BATCHES` parts by time of arrival; every seventh event arrives `DELAY` late."""
    events = table(spark, sf_dir, "events")
    late = F.expr(f"CASE WHEN event_id % 7 = 0 THEN ts + INTERVAL {DELAY} ELSE ts END")
    seconds = F.unix_timestamp(late.cast("timestamp"))
    start, end = events.agg(F.min(seconds), F.max(seconds)).first()
    part = F.least(
        F.floor((seconds - F.lit(start)) * BATCHES / F.lit(max((end or 0) - (start or 0), 1))), F.lit(BATCHES - 1)
    )
    part = F.coalesce(part, F.lit(0))
    return [events.where(part == i) for i in range(BATCHES)]


def frame_stream(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The frames of all event files that arrive below `folder`."""
    schema = table(spark, sf_dir, "events").schema
    return frames_from(spark.readStream.schema(schema).parquet(f"{folder}/batch=*")).drop("batch")


def session_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, fps, frame_total: one row per user; fps 0 falls back to the default."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(
        F.col("user_id").alias("session_id"),
        F.expr("user_id % 6 * 5").alias("fps"),
        F.expr("user_id * 37 % 4000").alias("frame_total"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(table(spark, sf_dir, "customer"), RUNS)


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(table(spark, sf_dir, "customer"), RESUMES)


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(table(spark, sf_dir, "orders"), EPOCHS)


def test_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(table(spark, sf_dir, "customer").where(TESTED), TEST_METRICS)


def per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(name) for name in settings.FINAL_CLASSES))
    rows = table(spark, sf_dir, "customer").where(TESTED).select(
        "c_custkey", F.posexplode(names).alias("class_order", "class_name")
    )
    return rows.select(
        F.expr("'run_' || c_custkey").alias("run"),
        "class_order",
        "class_name",
        F.expr(CLASS_AP).alias("ap50_95"),
    )


def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(table(spark, sf_dir, "customer").where(MEASURED), PERFORMANCE)


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'running' ELSE 'completed' END"
    return table(spark, sf_dir, "orders").select(
        F.expr("'run_' || o_custkey").alias("run"),
        F.col("o_orderkey").alias("attempt_id"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"),
        F.expr(status).alias("status"),
    )
