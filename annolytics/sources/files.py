"""Folders of single files, written from the tasks: one file a row.

Spark's own writers make one file a partition.  `FileSink` is a data source that writes a file a row, from
its bytes or as a copy of another file, straight to the store that the path names.  A file appears under
its name at once and whole, so a task that runs twice changes nothing.  Every task reports what it wrote;
the commit adds the reports up into `_WRITTEN.json`, which readers can wait for, and a failed job removes
its folder.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from annolytics.sources.storage import file_status

FORMAT = "annotation_files"
REPORT = "_WRITTEN.json"
COLUMNS = ("path", "content", "source", "sha256")
_CHUNK = 1 << 20


def _store(uri: str):
    """(file system, path) of a local path or URI."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri.replace("file:///", "/", 1).replace("file:/", "/", 1))


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote."""

    files: int
    size: int


class FileSink(DataSource):
    """Sink of rows (path, content, source, sha256).

    `path` lies below the folder.  The file gets `content`, or where that is null the bytes of the file
    `source`; bytes that do not have the digest `sha256`, if given, fail the job.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("files are written to a new folder only")
        if set(schema.names) != set(COLUMNS):
            raise ValueError(f"the columns must be {', '.join(COLUMNS)}")
        return FileWriter(self.options["path"])


class FileWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = _store(self.folder)
        made: set[str] = set()
        done = Written(0, 0)
        for row in iterator:
            target = posixpath.normpath(posixpath.join(root, row["path"]))
            if not target.startswith(root + "/"):
                raise ValueError(f"the path leaves the folder: {row['path']}")
            folder = posixpath.dirname(target)
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            draft = posixpath.join(folder, f".{uuid.uuid4().hex}")
            check, size = hashlib.sha256(), 0
            with system.open_output_stream(draft) as out:
                for part in _parts(row):
                    out.write(part)
                    check.update(part)
                    size += len(part)
            if row["sha256"] is not None and check.hexdigest() != row["sha256"]:
                system.delete_file(draft)
                raise ValueError(f"bytes have changed since they were read: {row['source'] or row['path']}")
            system.move(draft, target)
            done.files += 1
            done.size += size
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _store(self.folder)
        done = [m for m in messages if m is not None]
        report = {"files": sum(m.files for m in done), "bytes": sum(m.size for m in done), "tasks": len(done)}
        system.create_dir(root, recursive=True)
        with system.open_output_stream(posixpath.join(root, REPORT)) as out:
            out.write(json.dumps(report).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """The folder was made by this job, so nothing else is in it.  Tasks that are being killed may still write,
        so it is removed until it has stayed away for a second, for ten seconds at most."""
        from pyarrow.fs import FileType

        system, root = _store(self.folder)
        away, end = 0, time.monotonic() + 10
        while away < 4 and time.monotonic() < end:
            away += 1
            try:
                if system.get_file_info(root).type == FileType.Directory:
                    away = 0
                    system.delete_dir(root)
            except OSError:  # a task has changed it meanwhile
                pass
            time.sleep(0.25)
        if system.get_file_info(root).type == FileType.Directory:
            system.delete_dir(root)


def _parts(row: Row) -> Iterator[bytes]:
    if row["content"] is not None:
        yield bytes(row["content"])
        return
    system, path = _store(row["source"])
    with system.open_input_stream(path) as read:
        while part := read.read(_CHUNK):
            yield part


def write_files(rows: DataFrame, folder: str) -> dict[str, int]:
    """Write `rows(path, content, source, sha256)` below a folder that does not exist yet.  Returns files,
    bytes and tasks.  Two rows of one path are an error."""
    spark = rows.sparkSession
    if file_status(spark, folder) != "missing":
        raise FileExistsError(f"target already exists: {folder}")
    twice = rows.groupBy("path").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"several rows map to one output path: {twice[0]['path']}")
    spark.dataSource.register(FileSink)
    rows.select(*COLUMNS).write.format(FORMAT).mode("append").option("path", folder).save()
    system, root = _store(folder)
    with system.open_input_stream(posixpath.join(root, REPORT)) as report:
        return json.loads(report.read())


def text_files(rows: DataFrame, path: str, text: str) -> DataFrame:
    """Rows of a sink: the text of each row as a file."""
    return rows.select(
        F.col(path).alias("path"),
        F.encode(text, "utf-8").alias("content"),
        F.lit(None).cast("string").alias("source"),
        F.lit(None).cast("string").alias("sha256"),
    )


def copied_files(rows: DataFrame, path: str, source: str, sha256: str) -> DataFrame:
    """Rows of a sink: copies, which tasks make chunk by chunk; no bytes pass through Spark."""
    return rows.select(
        F.col(path).alias("path"),
        F.lit(None).cast("binary").alias("content"),
        F.col(source).alias("source"),
        F.col(sha256).alias("sha256"),
    )
