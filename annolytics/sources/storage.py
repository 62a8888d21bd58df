"""Questions to the file system that DataFrame readers do not answer, through Spark's own JVM.

Works with classic sessions only; no other module of `sources` holds JVM handles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_system(spark: SparkSession, path: str):
    """(file system, path) as the JVM sees them."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def file_status(spark: SparkSession, path: str) -> str:
    """`folder`, `file` or `missing`, on whatever file system the path names."""
    system, target = file_system(spark, path)
    if not system.exists(target):
        return "missing"
    return "folder" if system.getFileStatus(target).isDirectory() else "file"


def listed_paths(files: DataFrame) -> DataFrame:
    """path of every file that a file scan lists, empty ones included, which the scan itself leaves
    out.  The scan's listing is handed on inside the JVM."""
    spark = files.sparkSession
    jvm = spark.sparkContext._jvm
    names = jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(files._jdf.inputFiles())
    listed = spark._jsparkSession.createDataset(names, jvm.org.apache.spark.sql.Encoders.STRING())
    # the listing is URL-encoded, but a plus sign in it is a plus sign
    decoded = F.url_decode(F.replace("value", F.lit("+"), F.lit("%2B")))
    return DataFrame(listed.toDF(), spark).select(decoded.alias("path"))


def create_file(spark: SparkSession, path: str, text: str) -> None:
    """A small new text file."""
    system, target = file_system(spark, path)
    out = system.create(target, False)
    out.write(bytearray(text.encode()))
    out.close()
