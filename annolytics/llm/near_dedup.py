"""SimHash near-duplicates with BK-trees.

Fingerprints of 64 bits link at `RADIUS` or fewer differing bits.  Bits are cut into BLOCKS blocks; two
linked fingerprints agree on at least BLOCKS - RADIUS of them.  So every choice of that many blocks
makes shards: distinct fingerprints that agree on the chosen blocks.  A shard gets a BK-tree, whose
children are keyed by their distance to the parent, and a search follows only edges within the radius.
Trees grow with the data, so they are built where a shuffle has brought a shard together, and are not
broadcast.  Components of the links follow by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from annolytics.llm.common import keep_rows, row_digest, whole_text, written

SHINGLE = 4
RADIUS = 4
BLOCKS = 6
SEED = 42

# --- fingerprints ---------------------------------------------------------------------------------


def fingerprint(text: bytes) -> int:
    """Signed 64 bits.  Each bit is set if it is in over half the shingles' hashes."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII white-space bytes
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - SHINGLE + 1].tolist()
        hashes = [
            xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)
        ]
    raw = np.array(hashes, dtype="<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(raw), 65_536):
        bits = np.unpackbits(raw[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(counts * 2 > len(raw), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(rows: DataFrame) -> DataFrame:
    """`rows` has a binary column `body` last; it is replaced by `fp`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            found = pa.array([fingerprint(t.as_py()) for t in batch.column(last)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:last], found], names=[*batch.schema.names[:last], "fp"]
            )

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{fields}, fp bigint")


# --- links ----------------------------------------------------------------------------------------


def block_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Signed masks, one for each choice of blocks that linked fingerprints may agree on."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


class BKTree:
    """Fingerprints of one shard (as unsigned numbers), linked while they are added.

    Only what a fingerprint is connected to matters, so a search leaves out subtrees that lie
    wholly in the component it has already reached: a crowd of near copies costs little each.
    """

    def __init__(self, radius: int = RADIUS):
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.parent: list[int] = []  # union-find
        self.uniform: list[bool] = []  # the whole subtree is one component

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def add(self, value: int) -> None:
        values, children, radius = self.values, self.children, self.radius
        new = len(values)
        values.append(value)
        children.append({})
        self.parent.append(new)
        self.uniform.append(True)
        if not new:
            return
        stack = [0]
        while stack:
            node = stack.pop()
            if self.uniform[node] and self.find(node) == self.find(new):
                continue
            distance = (values[node] ^ value).bit_count()
            if distance <= radius:
                self.parent[self.find(new)] = self.find(node)
            for edge, child in children[node].items():
                if -radius <= edge - distance <= radius:
                    stack.append(child)
        node, path = 0, []
        while True:
            path.append(node)
            distance = (values[node] ^ value).bit_count()
            below = children[node].get(distance)
            if below is None:
                children[node][distance] = new
                break
            node = below
        for node in path:
            if self.uniform[node] and self.find(node) != self.find(new):
                self.uniform[node] = False

    def edges(self) -> Iterator[tuple[int, int]]:
        """Each linked value with one of its component."""
        for i, value in enumerate(self.values):
            root = self.find(i)
            if root != i:
                yield value, self.values[root]


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): enough links between `distinct(fp)` to connect all that the radius connects."""
    masks = F.array(*map(F.lit, block_masks()))
    keyed = distinct.select("fp", F.posexplode(masks).alias("choice", "mask")).select(
        "fp", "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("bits")
    )
    shards = keyed.repartition("choice", "bits").sortWithinPartitions("choice", "bits", "fp")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, key = BKTree(), None
        found: list[tuple[int, int]] = []

        def out() -> pa.RecordBatch:
            ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            fps, choice, bits = (batch.column(i).to_numpy() for i in range(3))
            unsigned = fps.view(np.uint64)
            starts = np.flatnonzero((choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1])) + 1
            bounds = [0, *starts.tolist(), len(fps)]
            for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                now = (choice[a], bits[a])
                if k or now != key:  # a shard may go on from the batch before
                    found.extend(tree.edges())
                    tree = BKTree()
                if b - a == 1 and 0 < k < len(bounds) - 2:
                    continue  # alone in its shard
                for value in unsigned[a:b].tolist():  # bits of negative numbers count differently
                    tree.add(value)
            key = (choice[-1], bits[-1])
            yield out()
            found.clear()
        found.extend(tree.edges())
        yield out()

    return shards.mapInArrow(link, "a bigint, b bigint").filter("a <> b").distinct()


# --- components -----------------------------------------------------------------------------------


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, root): every end of `edges(a, b)` with the smallest value of its component.

    Star contraction: each node points its larger neighbours, then its smaller ones, to the smallest
    it knows, until nothing changes; the number of rounds grows with the logarithm of the longest
    chain.  Minima are aggregated and joined back, so the neighbours of a hub never meet in one row.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
    seen = _signature(now)
    if not seen[0]:
        return now.select("a", F.col("b").alias("root"))
    while True:
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = written(
            both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(),
            "links",
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        now = written(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        last, seen = seen, _signature(now)
        if seen == last:
            break
    roots = now.select("a", F.col("b").alias("root"))
    return roots.unionAll(now.select(F.col("b").alias("a"), F.col("b").alias("root")).distinct())


def _fingerprint_classes(rows: DataFrame) -> DataFrame:
    """(fp, class_fp) for every fingerprint of `rows(fp)`."""
    distinct = written(rows.select("fp").distinct(), "fingerprints")
    roots = components(links(distinct))
    return distinct.join(roots.withColumnRenamed("a", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("class_fp")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    The component is the smallest id reachable over links.  Null and empty texts have fingerprint
    zero, linked like any other; null ids never name a component unless it has no other; repeated
    rows stay; very long texts are read whole; other columns are ignored; no rows give no rows.
    """
    rows = written(
        fingerprints(docs.select("doc_id", whole_text().cast("binary").alias("body"))), "documents"
    )
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = _fingerprint_classes(rows).join(least, "fp")
    named = classes.groupBy("class_fp").agg(F.min("least").alias("component_id"))
    by_fp = written(classes.join(named, "class_fp").select("fp", "component_id"), "components")
    return rows.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: that of the smallest id (null last),
    among rows of one id that with the smallest hash of all columns."""
    rows = written(
        fingerprints(
            docs.select("doc_id", row_digest(docs).alias("row"), whole_text().cast("binary").alias("body"))
        ),
        "documents",
    )
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    counted = rows.groupBy("fp", "doc_id", "row").count()
    first = counted.groupBy("fp").agg(F.min_by(F.struct("doc_id", "row", "count"), order).alias("d"))
    classed = first.join(_fingerprint_classes(rows), "fp").select("class_fp", "d.*")
    best = classed.groupBy("class_fp").agg(F.min_by(F.struct("doc_id", "row", "count"), order).alias("d"))
    winners = best.select("d.doc_id", "d.row", F.col("d.count").alias("copies"))
    return keep_rows(docs, written(winners, "kept"))
