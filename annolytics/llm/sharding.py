"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard.  At each level every child draws -ln(u)/weight with u from a
hash of the row's key and the child's name, and the smallest draw wins.  Draws do not depend on
siblings, so a changed weight moves rows only into or out of the subtree whose weight changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annolytics.llm.common import whole_text, written

SLOT_RANGES = 256


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def balanced_leaves(shards: int, per_rack: int = 2, racks: int = 2, whole: int = 8) -> list[Leaf]:
    """`whole` shards in full regions.  Each later shard is a region of its own: no inner weight
    changes when it comes, so it takes rows only into itself."""
    inner = per_rack * racks
    base = [Leaf(f"g{s // inner}", f"k{s // per_rack}", s) for s in range(min(shards, whole))]
    return base + [Leaf(f"g+{s}", f"k+{s}", s) for s in range(whole, shards)]


def _draw(key: Column, node: str, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node)), 11)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(2**53))) / F.lit(weight)


def _choose(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the smallest draw, among (name, weight, value)."""
    drawn = [F.struct(_draw(key, n, w).alias("d"), v.alias("v")) for n, w, v in children]
    return (F.least(*drawn) if len(drawn) > 1 else drawn[0])["v"]


def shard_of(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a key.  Weights of inner nodes are the sums of their shards; zero weights draw
    nothing."""
    live = [x for x in leaves if x.weight > 0]
    regions = []
    for region in dict.fromkeys(x.region for x in live):
        racks = []
        for rack in dict.fromkeys(x.rack for x in live if x.region == region):
            own = [x for x in live if (x.region, x.rack) == (region, rack)]
            shards = [(f"{region}/{rack}/{x.shard}", x.weight, F.lit(x.shard)) for x in own]
            racks.append((f"{region}/{rack}", sum(x.weight for x in own), _choose(key, shards)))
        regions.append((region, sum(x[1] for x in racks), _choose(key, racks)))
    return _choose(key, regions)


def _with_slots(rows: DataFrame) -> DataFrame:
    """slot: rank by id within the shard, from 0.  A shard holds a fixed part of all rows, so it is
    never sorted whole: ids are cut into ranges at quantiles, small counts per (shard, range) are
    summed up, and only one range of one shard is sorted at a time."""
    shares = [i / SLOT_RANGES for i in range(1, SLOT_RANGES)]
    cuts = sorted(set(rows.select(F.percentile_approx("doc_id", shares, 10_000)).first()[0] or []))
    part = F.coalesce(
        F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0),
        F.lit(-1),
    )
    # repeated rows are counted first, so that one id repeated many times does not fill a range
    fields = rows.columns
    ranged = rows.groupBy(*fields).count().withColumn("part", F.when(F.col("doc_id").isNull(), -1).otherwise(part))
    counts = ranged.groupBy("shard", "part").agg(F.sum("count").alias("n"))
    before = F.coalesce(
        F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = counts.select("shard", "part", before.alias("before"))
    order = W.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    inside = F.coalesce(F.sum("count").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return (
        ranged.withColumn("inside", inside)
        .join(offsets, ["shard", "part"])
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("count") - 1)))
        .select(*fields, (F.col("before") + F.col("inside") + F.col("copy")).alias("slot"))
    )


def assign_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    The key is the id; a null id has a fixed place of its own, equal ids share a shard.  A null
    text has size 1 and the checksum of the empty text.  Repeated rows get slots next to each
    other, other columns are ignored, and no rows give no rows.
    """
    text = whole_text()
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    placed = written(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.lit("key").alias("law"),
            shard_of(key, balanced_leaves(shards)).alias("shard"),
            shard_of(key, balanced_leaves(shards + 1)).alias("grown_shard"),
        ),
        "shards",
    )
    return _with_slots(placed)
