"""Best-fit packing under conflicts.

Documents go into bins of one capacity.  A bin never holds two members of a duplicate cluster, nor
more than `per_source` documents of a source.  Bins are kept in order of their residual and carry
bitmaps of their sources and clusters: the search starts at the tightest bin that fits and goes on to
its successors until one is compatible; if none is, a bin is opened.

Documents are dealt at random (by hash) into lots of about `lot` rows and every lot is packed by
itself, so work and memory of a task do not grow with the data.  No text is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.llm.common import lower_ascii, whole_text, written

CAPACITY = 16_384  # code points
LOT = 4_096
PER_SOURCE = 3


class BestFit:
    """One lot.  `residuals` is sorted (residual, bin); bitmaps are integers, one bit per source or
    cluster; `sources[bin][k]` has the sources of which the bin holds more than k documents."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.residuals: list[tuple[int, int]] = []
        self.sources: list[list[int]] = []
        self.clusters: list[int] = []
        self.fill: list[int] = []

    def open(self) -> int:
        self.sources.append([0] * self.per_source)
        self.clusters.append(0)
        self.fill.append(0)
        return len(self.clusters) - 1

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset in the bin).  source and cluster are single bits; 0 conflicts with none."""
        at = bisect_left(self.residuals, (size, -1))
        while at < len(self.residuals):
            bin_id = self.residuals[at][1]
            if not (self.clusters[bin_id] & cluster or self.sources[bin_id][-1] & source):
                break
            at += 1
        if at < len(self.residuals):
            self.residuals.pop(at)
        else:
            bin_id = self.open()
        for k, plane in enumerate(self.sources[bin_id]):
            if not plane & source:
                self.sources[bin_id][k] = plane | source
                break
        self.clusters[bin_id] |= cluster
        offset = self.fill[bin_id]
        self.fill[bin_id] += size
        insort(self.residuals, (self.capacity - self.fill[bin_id], bin_id))
        return bin_id, offset


def pack_lot(items: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    """Largest first.  Adds bin and offset."""
    order = items.sort_values(["size", "doc_id", "cluster", "copy"], ascending=[False, True, True, True])
    lot = BestFit(capacity, per_source)
    repeated = order["cluster"].value_counts()
    shared = {c: 1 << i for i, c in enumerate(repeated.index[repeated > 1])}  # others cannot conflict
    named = {s: 1 << i for i, s in enumerate(order["source"].dropna().unique())}
    placed = [
        lot.place(size, named.get(source, 0), shared.get(cluster, 0))
        for size, source, cluster in zip(order["size"], order["source"], order["cluster"], strict=True)
    ]
    return order.assign(bin=[b for b, _ in placed], offset=[o for _, o in placed])


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, lot: int = LOT) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, lot, bin, offset, source, cluster.

    A text longer than the capacity is cut into pieces: full ones, which are bins of their own
    (lot null, bin null), and the rest, which is packed.  start and length (code points) say what
    of the text a piece holds; offset is its place in the bin.  Null and empty texts are pieces of
    length 0.  Equal texts after lower-casing A-Z are a cluster, repeated rows included.  A null
    source conflicts with none.  Other columns are ignored; no rows give no rows.
    """
    text = whole_text()
    length = F.length(text)
    rows = written(
        docs.select(
            "doc_id",
            F.col("source").cast("string").alias("source"),
            F.xxhash64(lower_ascii(text)).alias("cluster"),
            length.cast("bigint").alias("n"),
        )
        .groupBy("doc_id", "source", "cluster", "n")
        .count(),  # repeated rows: counted, then dealt to different lots
        "packing",
    ).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "count")))
    lots = -(-rows.count() // lot) or 1
    full = F.when(F.col("n") > 0, F.floor((F.col("n") - 1) / capacity)).otherwise(0)
    items = rows.select(
        "doc_id",
        full.cast("bigint").alias("piece"),
        (full * capacity).cast("bigint").alias("start"),
        (F.col("n") - full * capacity).cast("bigint").alias("size"),
        F.pmod(F.xxhash64("doc_id", "cluster", "copy", F.lit("lot")), F.lit(lots)).alias("lot"),
        "source",
        "cluster",
        "copy",
    )
    fields = ", ".join(f"`{c}` {t}" for c, t in items.dtypes)
    schema = f"{fields}, bin bigint, offset bigint"
    packed = (
        items.groupBy("lot")
        .applyInPandas(lambda pdf: pack_lot(pdf, capacity, per_source), schema)
        .select("doc_id", "piece", "start", F.col("size").alias("length"), "lot", "bin", "offset", "source", "cluster")
    )
    whole = rows.filter(F.col("n") > capacity).select(
        "doc_id",
        F.explode(F.sequence(F.lit(0).cast("bigint"), full.cast("bigint") - 1)).alias("piece"),
        "source",
        "cluster",
    )
    return packed.unionByName(
        whole.select(
            "doc_id",
            "piece",
            (F.col("piece") * capacity).alias("start"),
            F.lit(capacity).cast("bigint").alias("length"),
            F.lit(None).cast("bigint").alias("lot"),
            F.lit(None).cast("bigint").alias("bin"),
            F.lit(0).cast("bigint").alias("offset"),
            "source",
            "cluster",
        )
    )
