"""Small helpers that several corpus operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolytics.session import fresh_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """A text column; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z only: other letters stay as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """`names`, each lengthened until it clashes with no column of `df` (in any case)."""
    taken = {c.lower() for c in df.columns}
    free = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        free.append(name)
    return free


def written(df: DataFrame, purpose: str) -> DataFrame:
    """`df`, written once to the shared folder and read from there.

    Cuts lineage, keeps column pruning, and survives the loss of any executor.
    """
    path = fresh_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_digest(df: DataFrame) -> Column:
    """A hash of all columns.  Variants and maps cannot be hashed and are cast to text first."""
    return F.xxhash64(
        *(F.col(f"`{c}`").cast("string") if t.startswith(("map", "variant")) else F.col(f"`{c}`")
          for c, t in df.dtypes)
    )


def keep_rows(docs: DataFrame, winners: DataFrame) -> DataFrame:
    """The rows of `docs` that `winners(doc_id, row, copies)` names; `row` is `row_digest`.

    Texts are not shuffled unless a winner stands for several rows alike in every column
    (`copies` > 1).  Of such rows one is kept.
    """
    key, other, row, digest, copies = free_names(docs, "_id", "_other", "_row", "_digest", "_copies")
    named = docs.withColumns({key: F.col("doc_id"), row: row_digest(docs)})
    wanted = winners.select(
        F.col("doc_id").alias(other), F.col("row").alias(digest), F.col("copies").alias(copies)
    )

    def joined(side: DataFrame) -> DataFrame:
        match = F.col(key).eqNullSafe(F.col(other)) & (F.col(row) == F.col(digest))
        return named.join(side, match, "left_semi")

    single = joined(wanted.filter(F.col(copies) == 1))
    repeated = joined(wanted.filter(F.col(copies) > 1)).dropDuplicates([key, row])
    return single.unionByName(repeated).select(*(F.col(f"`{c}`") for c in docs.columns))


def extended(df: DataFrame, name: str, kind: str) -> T.StructType:
    """The schema of `df` and one more field."""
    field = T.StructField(name, T.DataType.fromDDL(kind))
    return T.StructType([*df.schema.fields, field])
