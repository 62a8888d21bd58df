"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest.  New data is reduced to one row per digest,
dealt into the same buckets, held against the index by a sort-merge anti-join, and what is new is
appended.  Texts are read once and never shuffled: only digests and ids move.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annolytics.llm.common import keep_rows, lower_ascii, row_digest, whole_text, written
from annolytics.sources.storage import create_file, file_status

INDEX_SCHEMA = "digest string, keep_id bigint"


def text_digest(column: str = "text") -> Column:
    """Texts are equal when identical after lower-casing A-Z; null counts as empty."""
    return F.sha2(lower_ascii(whole_text(column)).cast("binary"), 256)


class DigestIndex:
    """A bucketed table (digest, keep_id), one row per digest ever seen.

    `buckets` is fixed when the table is made; choose it for the final size of the index.  With `folder`
    the index lies there and outlives the session's catalog: a later session that names the folder goes
    on with what it holds.  Without, the table belongs to the catalog.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int, folder: str | None = None):
        self.spark, self.name, self.buckets = spark, name, buckets
        if spark.catalog.tableExists(name):
            return
        if folder is None:
            self._append(spark.createDataFrame([], INDEX_SCHEMA))
            return
        note = f"{folder.rstrip('/')}/buckets.txt"
        if file_status(spark, note) == "file":
            known = int(spark.read.text(note).first()[0])
            if known != buckets:
                raise ValueError(f"the index in {folder} has {known} buckets")
        else:
            create_file(spark, note, str(buckets))
        place = folder.rstrip("/").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {name} ({INDEX_SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
            f"INTO {buckets} BUCKETS LOCATION '{place}/data'"
        )

    def drop(self) -> None:
        """Take the table out of the catalog; its data go with it unless they lie in a named folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _append(self, rows: DataFrame) -> None:
        (
            rows.repartition(self.buckets, "digest")  # one file per bucket and append
            .write.format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .mode("append")
            .saveAsTable(self.name)
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, candidates: DataFrame) -> DataFrame:
        """Rows of `candidates(digest, ...)` whose digest the index lacks."""
        dealt = candidates.repartition(self.buckets, "digest")
        return dealt.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def add(self, entries: DataFrame) -> None:
        """Append the unseen rows of `entries(digest, doc_id, ...)`; the largest id of a digest
        stands for it.  A digest seen before keeps the id it has."""
        best = entries.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        self._append(self.unseen(best).select("digest", "keep_id"))


def fresh_index(spark: SparkSession) -> DigestIndex:
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return DigestIndex(spark, f"llm_digests_{os.urandom(6).hex()}", buckets)


def _add_newest_first(index: DigestIndex, entries: DataFrame) -> None:
    """Two batches, the larger ids first, so that the index keeps the largest id of each digest."""
    middle = entries.select(F.percentile_approx("doc_id", 0.5, 1000)).first()[0]
    newer = F.coalesce(F.col("doc_id") > F.lit(middle).cast("bigint"), F.lit(False))
    index.add(entries.filter(newer))
    index.add(entries.filter(~newer))


def exact_groups(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the largest id of a group of equal texts stays; a null id is the smallest.  Of
    rows alike in id and text one is kept.  Null texts count as empty, very long ones are hashed
    whole, other columns are ignored, and no rows give no rows.  Several rows of one digest are
    counted before they move, so a group holding a third of all rows costs one row per id.
    """
    rows = written(
        docs.select("doc_id", text_digest().alias("digest")).groupBy("digest", "doc_id").count(),
        "digests",
    )
    _add_newest_first(index, rows)
    sizes = rows.groupBy("digest").agg(F.sum("count").alias("group_size"))
    # written, so that the join below reads plain shuffles and a hot digest can be split
    groups = written(sizes.join(index.read(), "digest"), "groups")
    return (
        rows.join(groups, "digest")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "count")))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
    )


def drop_copies(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    As `exact_groups`; where rows share text and id but differ elsewhere, the one with the largest
    hash of all columns stays.
    """
    rows = written(
        docs.select("doc_id", row_digest(docs).alias("row"), text_digest().alias("digest"))
        .groupBy("digest", "doc_id", "row")
        .count(),
        "digests",
    )
    _add_newest_first(index, rows)
    ids = index.read().withColumnsRenamed({"digest": "known", "keep_id": "stays"})
    same = (F.col("digest") == F.col("known")) & F.col("doc_id").eqNullSafe(F.col("stays"))
    winners = (
        rows.join(ids, same)
        .groupBy("digest", "doc_id")
        .agg(F.max(F.struct("row", "count")).alias("best"))
        .select("doc_id", F.col("best.row").alias("row"), F.col("best.count").alias("copies"))
    )
    return keep_rows(docs, written(winners, "kept"))
