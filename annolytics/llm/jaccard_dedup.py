"""Near copies by the Jaccard similarity of word shingles: MinHash bands, then exact checks.

Texts are sets of hashed shingles; equal sets are one node.  Nodes that agree on a band of MinHash values
share a bucket.  Every bucket is compared with one node of it, exactly, twice; most near copies are
connected then.  What two unconnected nodes of a bucket still might share is found by an exact prefix
filter: shingles are ordered from rare to frequent, and two sets as similar as wanted have one in common
among the first of both.  So texts that are only somewhat alike, whose rare shingles are their
own, never meet, however many they are.  Those that meet are compared with a few nodes of the largest part among them, round
after round as long as that finds links, and only what stays unconnected with all.  Pairs are rows, so no bucket meets in
one task.

Links that another method finds between SimHash fingerprints (`near_dedup.links`) can go first: those that the
exact check confirms need no bucket, and what they connect is not compared again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from annolytics.llm.common import keep_rows, row_digest, whole_text, written
from annolytics.llm.near_dedup import SEED, components, fingerprint

SHINGLE = 5
SIMILARITY = 0.8
# A pair at 0.8 shares no bucket with probability (1 - 0.8 ** 5) ** 24 = 7e-5.
BANDS, PER_BAND = 24, 5
STARS = 2  # rounds in which buckets are compared with one of their nodes
PROBES, CENTRES = 4, 32  # rounds at most in which posts are compared with nodes of their shingle's largest part

_RNG = np.random.default_rng(SEED)
_XOR = _RNG.integers(0, 1 << 64, (BANDS * PER_BAND, 1), np.uint64)
_TIMES = _RNG.integers(0, 1 << 64, (BANDS * PER_BAND, 1), np.uint64) | np.uint64(1)
_MIX = _RNG.integers(0, 1 << 64, (BANDS, PER_BAND), np.uint64) | np.uint64(1)


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of `size` words in a row, A-Z lower-cased; a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: max(1, len(words) - size + 1)].tolist()
    stops = ends[min(size, len(words)) - 1 :].tolist()
    return np.unique(
        np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)
    )


def node(found: np.ndarray) -> int:
    """Signed 64 bits that stand for a set."""
    return int(np.array([xxh64_intdigest(found.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def band_keys(found: np.ndarray) -> np.ndarray:
    """One signed key a band."""
    least = np.full(BANDS * PER_BAND, ~np.uint64(0))
    for i in range(0, len(found), 4_096):
        values = (found[i : i + 4_096] ^ _XOR) * _TIMES
        np.minimum(least, values.min(axis=1), out=least)
    return (least.reshape(BANDS, PER_BAND) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


# --- nodes and buckets ----------------------------------------------------------------------------


def _nodes(rows: DataFrame, size: int, marked: bool) -> DataFrame:
    """`rows(doc_id, row, body)` as (doc_id, row, node, keys, fp); the SimHash `fp` is null unless `marked`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            sets = [shingles(t, size) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array([node(s) for s in sets], pa.int64()),
                    pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())),
                    pa.array([fingerprint(t) if marked else None for t in texts], pa.int64()),
                ],
                names=["doc_id", "row", "node", "keys", "fp"],
            )

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, row bigint, node bigint, keys array<bigint>, fp bigint")


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """`rows(node, body)` as (node, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), size).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return rows.mapInArrow(run, "node bigint, shingles binary")


def _members(nodes: DataFrame) -> DataFrame:
    """(bucket, node): buckets of two nodes or more; of buckets with the same members, one."""
    keyed = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    mark = F.xxhash64("node")
    buckets = (
        keyed.groupBy("band", "key")
        .agg(
            F.count("*").alias("size"),
            F.bit_xor(mark).alias("x"),
            F.sum(F.shiftright(mark, 31)).alias("y"),  # small enough to be summed without overflow
            F.min(mark).alias("z"),
        )
        .filter("size > 1")
    )
    one = buckets.groupBy("size", "x", "y", "z").agg(F.min(F.struct("band", "key")).alias("b"))
    return keyed.join(one.select("b.band", "b.key"), ["band", "key"]).select(
        F.struct("band", "key").alias("bucket"), "node"
    )


# --- links ----------------------------------------------------------------------------------------


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of `pairs(a, b)` that are as similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(s.as_buffer(), np.uint64) for s in batch.column(i)] for i in (2, 3))
            good = pa.array([jaccard(s, t) >= similarity for s, t in zip(a, b, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(good)

    # `a` is the centre of a star, so `b` is spread better and goes first
    full = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b").join(
        sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a"
    )
    return full.select("a", "b", "of_a", "of_b").mapInArrow(run, "a bigint, b bigint")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """`rows(node, ...)` with the `root` of each node; one without links is its own."""
    return rows.join(roots.withColumnRenamed("a", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))


def _open(rows: DataFrame, key: str) -> DataFrame:
    """Those of `rows(key, root, ...)` whose key has several roots."""
    several = rows.groupBy(key).agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s")
    return rows.join(several.select(key), key)


def _prefixes(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(shingle, node, size, place): for `nodes(node)` the shingles by which similar ones are found.

    Shingles go from rare to frequent among `nodes`.  Of two sets with a Jaccard similarity of s, the first
    that they share has at most size - s * size before it in either.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [np.frombuffer(s.as_buffer(), np.int64) for s in part.column(1)]
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(part.column(0).to_numpy(), sizes)),
                        pa.array(np.repeat(sizes, sizes)),
                        pa.array(np.concatenate(found)),
                    ],
                    names=["node", "size", "shingle"],
                )

    rows = written(
        nodes.join(sets, "node").select("node", "shingles").mapInArrow(run, "node bigint, size bigint, shingle bigint"),
        "open-shingles",
    )
    shared = rows.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    within = Window.partitionBy("node")  # the shingles of one text
    own = F.col("size") - F.count("*").over(within)
    placed = rows.join(shared, "shingle").withColumn(
        "place", own + F.row_number().over(within.orderBy("df", "shingle"))
    )
    least = F.ceil(F.col("size") * F.lit(similarity) - 1e-9)
    return placed.filter(F.col("place") <= F.col("size") - least + 1).select("shingle", "node", "size", "place")


def _possible(similarity: float) -> Column:
    """Of posts x and y of one shingle, the first that two sets share: whether enough can follow."""
    share = similarity / (1 + similarity)
    least = F.ceil((F.col("x.size") + F.col("y.size")) * F.lit(share) - 1e-9)
    after = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
    return (F.col("x.root") != F.col("y.root")) & (after + 1 >= least)


def _star(rows: DataFrame, key: str, salt: int, condition: Column) -> DataFrame:
    """(a, b): in each group of `rows(key, node, root, ...)` one node against those that the condition allows."""
    draw = F.xxhash64(F.lit(salt), key, "node")
    columns = [c for c in rows.columns if c != key]
    centres = rows.groupBy(key).agg(F.min_by(F.struct(*columns), draw).alias("c")).select(key, "c.*")
    pairs = rows.alias("y").join(centres.alias("x"), F.col(f"x.{key}") == F.col(f"y.{key}")).filter(condition)
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _fingerprint_links(nodes: DataFrame, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b): links between `nodes(node, fp)`: of one fingerprint, or of fingerprints that `linked` links.  A node
    may have several: its texts differ in the order or repetition of their shingles."""
    pairs = nodes.select("node", "fp").distinct()
    first = pairs.groupBy("fp").agg(F.min("node").alias("first"))
    found = linked(written(first.select("fp"), "fingerprints"))
    ends = found.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(
        first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b"
    )
    same = pairs.join(first, "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return same.unionByName(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).filter("a <> b").distinct()


def _merged(roots: DataFrame | None, found: DataFrame) -> DataFrame:
    """`roots(a, root)` of earlier links, with the links `found(a, b)` taken in: only roots that these join are walked
    again."""
    if roots is None:
        return written(components(found), "roots")
    for end in ("a", "b"):
        known = roots.select(F.col("a").alias(end), F.col("root").alias("of"))
        found = found.join(known, end, "left").withColumn(end, F.coalesce("of", end)).drop("of")
    joined = written(components(found.filter("a <> b").distinct()), "joined")
    moved = roots.join(joined.select(F.col("a").alias("root"), F.col("root").alias("least")), "root", "left")
    fresh = joined.join(roots.select("a"), "a", "left_anti")
    return written(moved.select("a", F.coalesce("least", "root").alias("root")).unionByName(fresh), "roots")


def _marked(posts: DataFrame, roots: DataFrame) -> DataFrame:
    """The open ones of `posts`, with the `largest` root of each shingle."""
    still = written(_open(_rooted(posts, roots), "shingle"), "open-posts")
    largest = (
        still.groupBy("shingle", "root").count().groupBy("shingle").agg(F.max_by("root", "count").alias("largest"))
    )
    return still.join(largest, "shingle")


def _probes(marked: DataFrame, salt: int, similarity: float) -> DataFrame:
    """(a, b): up to CENTRES nodes of each shingle's largest root, the same ones wherever they occur, against the nodes
    of other roots."""
    draw = F.xxhash64(F.lit(salt), "node")
    post = F.struct("node", "root", "size", "place")
    centres = (
        marked.filter("root = largest")
        .groupBy("shingle", F.pmod(draw, F.lit(CENTRES)).alias("part"))
        .agg(F.min_by(post, draw).alias("c"))
        .select("shingle", "c.*")
    )
    others = marked.filter("root <> largest").alias("y")
    pairs = others.join(centres.alias("x"), F.col("x.shingle") == F.col("y.shingle")).filter(_possible(similarity))
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _classes(members: DataFrame, sets: DataFrame, similarity: float, links: DataFrame | None = None) -> DataFrame:
    """(a, root) of all linked nodes; `links` are pairs that are likely ones."""
    if links is None:
        roots, still = None, members.withColumn("root", F.col("node"))
    else:
        roots = _merged(None, _confirmed(links, sets, similarity))
        still = written(_open(_rooted(members, roots), "bucket"), "open")
    apart = F.col("x.root") != F.col("y.root")
    for salt in range(STARS):
        roots = _merged(roots, _confirmed(_star(still, "bucket", salt, apart), sets, similarity))
        still = written(_open(_rooted(members, roots), "bucket"), "open")
    posts = written(_prefixes(still.select("node").distinct(), sets, similarity), "posts")
    # most of what belongs to a large part is linked to one of a few of its nodes; each round costs no more than
    # CENTRES pairs a post
    for salt in range(PROBES):
        found = _confirmed(_probes(_marked(posts, roots), salt, similarity), sets, similarity)
        found = written(found, "links")
        if found.isEmpty():
            break
        roots = _merged(roots, found)
    # every pair left, but for those within the largest part that is connected already
    marked = _marked(posts, roots)
    minor = marked.filter("root <> largest")
    once = (F.col("y.root") == F.col("y.largest")) | (F.col("x.node") < F.col("y.node"))
    pairs = (
        minor.alias("x")
        .join(marked.alias("y"), F.col("x.shingle") == F.col("y.shingle"))
        .filter(_possible(similarity) & once)
        .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
        .distinct()
    )
    return _merged(roots, _confirmed(pairs, sets, similarity))


def similar_classes(
    docs: DataFrame,
    size: int = SHINGLE,
    similarity: float = SIMILARITY,
    linked: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(doc_id, row, class) of every row; `row` is `row_digest`.  Null and empty texts are one class.  `linked` gives
    links (a, b) between distinct SimHash fingerprints (fp), whose texts are compared first."""
    named = docs.select("doc_id", row_digest(docs).alias("row"), whole_text().cast("binary").alias("body"))
    rows = written(_nodes(named, size, linked is not None), "documents")
    nodes = rows.groupBy("node").agg(F.first("keys").alias("keys"))
    members = written(_members(nodes), "members")
    # one row for each node that is to be compared
    needed, likely = members.select("node"), None
    if linked is not None:
        likely = written(_fingerprint_links(rows, linked), "likely")
        needed = needed.union(likely.select("a")).union(likely.select("b"))
    needed = needed.distinct()
    source = (
        rows.join(needed, "node", "left_semi")
        .groupBy("node")
        .agg(F.min(F.struct(F.xxhash64("doc_id").alias("i"), "row")).alias("d"))
        .select("node", "d.*")
    )
    texts = named.withColumn("i", F.xxhash64("doc_id")).join(source, ["i", "row"]).select("node", "body")
    sets = written(_sets(texts, size).dropDuplicates(["node"]), "shingles")
    roots = _classes(members, sets, similarity, likely)
    return rows.join(roots.withColumnRenamed("a", "node"), "node", "left").select(
        "doc_id", "row", F.coalesce("root", "node").alias("class")
    )


def drop_similar(
    docs: DataFrame,
    size: int = SHINGLE,
    similarity: float = SIMILARITY,
    linked: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One document of each class, with all its columns: that of the smallest id (null last), among
    rows of one id that with the smallest hash of all columns."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    counted = similar_classes(docs, size, similarity, linked).groupBy("class", "doc_id", "row").count()
    best = counted.groupBy("class").agg(F.min_by(F.struct("doc_id", "row", "count"), order).alias("d"))
    winners = best.select("d.doc_id", "d.row", F.col("d.count").alias("copies"))
    return keep_rows(docs, written(winners, "kept"))
