"""Write results: never over the source, and visible only when complete."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from annolytics.sources.storage import file_status, file_system

_MARK = "_PUBLISHED"


def check_target(spark: SparkSession, source_root: str, target: str, overwrite: bool) -> None:
    """Refuse a target that overlaps the source, or that exists unless `overwrite`."""
    a, b = source_root.rstrip("/") + "/", target.rstrip("/") + "/"
    if a.startswith(b) or b.startswith(a):
        raise ValueError(f"source and target must not overlap: {source_root} / {target}")
    if file_status(spark, target) != "missing" and not overwrite:
        raise FileExistsError(f"target already exists: {target}")


def publish(
    tables: Mapping[str, DataFrame],
    target: str,
    audit: Callable[[Callable[[str], DataFrame]], None] | None = None,
    partition_by: Mapping[str, str] | None = None,
) -> str:
    """Write the tables as a new version below `target`, audit what was written, then mark the
    version as published.  Readers only see marked versions, so a failed write or audit leaves the
    previous version in place.  Returns the folder of the version."""
    spark = next(iter(tables.values())).sparkSession
    version = max(_versions(spark, target), default=0) + 1
    folder = f"{target.rstrip('/')}/v={version}"
    for name, table in tables.items():
        writer = table.write.mode("errorifexists")
        if partition_by and name in partition_by:
            writer = writer.partitionBy(partition_by[name])
        writer.parquet(f"{folder}/{name}")
    if audit is not None:
        audit(lambda name: spark.read.parquet(f"{folder}/{name}"))
    system, mark = file_system(spark, f"{folder}/{_MARK}")
    system.create(mark, False).close()
    return folder


def published(spark: SparkSession, target: str) -> str:
    """Folder of the newest published version."""
    for version in sorted(_versions(spark, target), reverse=True):
        folder = f"{target.rstrip('/')}/v={version}"
        if file_status(spark, f"{folder}/{_MARK}") == "file":
            return folder
    raise FileNotFoundError(f"nothing is published at {target}")


def read_published(spark: SparkSession, target: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{published(spark, target)}/{name}")


def write_report(table: DataFrame, path: str, kind: str = "json") -> None:
    """A report table as JSON lines or CSV with a header; an existing report is an error."""
    writer = table.write.mode("errorifexists")
    if kind == "json":
        writer.json(path)
    elif kind == "csv":
        writer.csv(path, header=True)
    else:
        raise ValueError("a report is written as json or csv")


def write_reports(tables: Mapping[str, DataFrame], folder: str, started: datetime) -> None:
    """One CSV report a table below a new folder, and last `run` (JSON): when the job started and finished,
    in UTC, and the seconds between, with the rows of every report, counted while they are written."""
    spark = next(iter(tables.values())).sparkSession
    if file_status(spark, folder) != "missing":
        raise FileExistsError(f"target already exists: {folder}")
    seen = {}
    for name, table in tables.items():
        seen[name] = Observation()
        write_report(table.observe(seen[name], F.count(F.lit(1)).alias("rows")), f"{folder}/{name}", "csv")
    finished = datetime.now(UTC)
    row = (started, finished, (finished - started).total_seconds(), {n: o.get["rows"] for n, o in seen.items()})
    kind = "started timestamp, finished timestamp, elapsed_seconds double, rows map<string, long>"
    write_report(spark.createDataFrame([row], kind), f"{folder}/run", "json")


def _versions(spark: SparkSession, target: str) -> list[int]:
    system, path = file_system(spark, target)
    if not system.exists(path):
        return []
    names = [status.getPath().getName() for status in system.listStatus(path)]
    return [int(name[2:]) for name in names if name.startswith("v=") and name[2:].isdigit()]
