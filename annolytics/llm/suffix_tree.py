"""Language-model scoring with a probabilistic suffix tree.

Texts are sequences of bytes with an end.  A context of up to DEPTH bytes that precedes LEAST positions
or more stays in the tree if its next-byte distribution diverges from that of the context one byte
shorter.  Distributions are smoothed towards the longest shorter context's that stayed, more so the more
different bytes were seen, and each position of a text is scored from the longest suffix that stayed.

LEAST does not depend on the input, so the tree grows with it, and neither the tree nor the word counts
are ever collected or broadcast.  A block of documents has its distinct grams (a context of
DEPTH bytes and the next one) and words; these are joined with the probabilities and counts, and come back to
the block, where the texts are scored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.llm.common import id_crc, whole_text, written

DEPTH = 5
LEAST = 20  # positions that a context must precede
DIVERGENCE = 0.01  # nats
BLOCK_BYTES = 8 << 20  # text that shares one local vocabulary
GROUP_GRAMS = 1 << 16  # distinct grams whose probabilities one task works out together, about
BUCKET_KEYS = 1 << 20  # grams or words of blocks that one task looks up together, about

BITS = 8
SYMBOLS = 1 << BITS
END = 0xFF  # no UTF-8 text holds this byte; it stands for the end
PAD = bytes([END]) * DEPTH
END_WORD = b""  # the end as a token
BETWEEN = b"\n"  # no word holds white space
LOW = 2  # contexts of up to LOW bytes are worked out first: at most 2^24 grams


def _stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams, start, end) of texts one after another, each after PAD; the end mark counts as a
    position of its text.  The first byte of a gram is in its highest bits."""
    raw = np.frombuffer(PAD + b"".join(t + PAD for t in texts), np.uint8)
    grams = raw[:-DEPTH].astype(np.int64)
    for d in range(1, DEPTH + 1):
        grams <<= BITS
        grams |= raw[d : len(raw) - DEPTH + d]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.cumsum(np.concatenate([[0], lengths[:-1] + DEPTH]))
    return grams, start, start + lengths + 1


def _suffix(gram, depth: int):
    """The last `depth` bytes of the context, and the next byte."""
    return gram & (1 << BITS * (depth + 1)) - 1


# --- arrays in few bytes --------------------------------------------------------------------------


def _small(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _whole(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _pack(numbers: np.ndarray) -> bytes:
    """Byte by byte place: the upper bytes of small numbers are runs of zeros."""
    return _small(numbers.view(np.uint8).reshape(len(numbers), -1).T.tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(_whole(data), np.uint8)
    return planes.reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _pack_grams(grams: np.ndarray) -> bytes:
    return _pack(np.diff(grams, prepend=0))


def _unpack_grams(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.int64))


def _pack_words(words: np.ndarray) -> bytes:
    return _small(BETWEEN.join(words.tolist()))


def _unpack_words(data: bytes) -> np.ndarray:
    """Words that `_pack_words` was given; these must be one at least."""
    return np.array(_whole(data).split(BETWEEN), object)


def _gram_bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    return grams % buckets


def _word_bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.int64, len(words)) % buckets


# --- blocks of documents --------------------------------------------------------------------------

_BLOCK_TYPES = {
    "block": pa.int64(), "ids": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "texts": pa.binary(),
    "words": pa.binary(), "word_times": pa.binary(), "n_words": pa.int64(),
    "grams": pa.binary(), "gram_times": pa.binary(), "n_grams": pa.int64(),
}
_BLOCK_DDL = (
    "block bigint, ids array<bigint>, held array<boolean>, texts binary, words binary, word_times binary, "
    "n_words bigint, grams binary, gram_times binary, n_grams bigint"
)


def _row(**values) -> pa.RecordBatch:
    arrays = [pa.array([values.get(name)], kind) for name, kind in _BLOCK_TYPES.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(_BLOCK_TYPES))


def _parts(batches) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of batches (doc_id, held, body) with lower-cased texts, of about a megabyte."""
    for batch in batches:
        at, texts, size = 0, [], 0
        for i, text in enumerate(batch.column(2)):
            texts.append(text.as_py().lower())
            size += len(texts[-1])
            if size >= 1 << 20 or i + 1 == batch.num_rows:
                yield batch.slice(at, len(texts)), texts
                at, texts, size = i + 1, [], 0


def _merged(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, sorted, and the sums of their counts."""
    grams = np.concatenate([g for g, _ in counts])
    order = np.argsort(grams, kind="stable")
    grams, n = grams[order], np.concatenate([n for _, n in counts])[order]
    first = np.flatnonzero(np.diff(grams, prepend=-1))
    return grams[first], np.add.reduceat(n, first) if len(first) else n


def blocks(docs: DataFrame) -> DataFrame:
    """`docs(doc_id, held, body)` as rows of blocks: one a megabyte of documents, and one with the distinct words
    and grams of the block.  Times count training texts; what only held-out texts hold has 0 there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, used = TaskContext.get().partitionId() << 32, 0
        words: Counter = Counter()
        counts: list[tuple[np.ndarray, np.ndarray]] = []

        def vocabulary() -> pa.RecordBatch:
            own = np.array(sorted(words), object)
            times = np.fromiter(map(words.__getitem__, own), np.int64, len(own))
            grams, n = _merged(counts)
            return _row(
                block=block, words=_pack_words(own), word_times=_pack(times), n_words=len(own),
                grams=_pack_grams(grams), gram_times=_pack(n), n_grams=len(grams),
            )

        for batch, texts in _parts(batches):
            held = batch.column(1).to_numpy(zero_copy_only=False)
            for text, out in zip(texts, held.tolist(), strict=True):
                if out:
                    for word in text.split():
                        words.setdefault(word, 0)
                    words.setdefault(END_WORD, 0)
                else:
                    words.update(text.split())
                    words[END_WORD] += 1
                used += len(text)
            grams, _, end = _stream(texts)
            taken = np.repeat(~held, [len(t) + DEPTH for t in texts])
            real = np.ones(len(grams), bool)
            for k in range(DEPTH - 1):
                real[end + k] = False  # padding
            counts.append(np.unique(grams[real & taken], return_counts=True))
            unseen = np.unique(grams[real & ~taken])
            counts.append((unseen, np.zeros(len(unseen), np.int64)))
            # no text holds the byte of the end
            packed = _small(bytes([END]).join(texts))
            yield _row(block=block, ids=batch.column(0).to_pylist(), held=held.tolist(), texts=packed)
            if used >= BLOCK_BYTES:
                yield vocabulary()
                block, used, words, counts = block + 1, 0, Counter(), []
        if counts:
            yield vocabulary()

    return written(docs.mapInArrow(run, _BLOCK_DDL), "blocks")


# --- the tree -------------------------------------------------------------------------------------


def descend(gram, n, p, q, depth, depths, least, divergence) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability, raw share and depth of the state of each gram after `depths`, from those after the
    depth before.  All grams that share a context of the first of `depths` must be given."""
    for d in depths:
        own, first, at = np.unique(_suffix(gram, d), return_index=True, return_inverse=True)
        seen = np.bincount(at, n, len(own))
        wider, share, state = p[first], q[first], depth[first]
        context = np.unique(own >> BITS, return_inverse=True)[1]
        total = np.bincount(context, seen)
        kinds = np.bincount(context, seen > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            each = np.where(seen > 0, seen * np.log(seen / share), 0)
            gain = np.bincount(context, each) / total - np.log(total)
            stays = ((total >= least) & (gain >= divergence))[context]
            smooth = (seen + kinds[context] * wider) / (total + kinds)[context]
            share = seen / total[context]
        p, q, depth = np.where(stays, smooth, wider)[at], share[at], np.where(stays, d, state)[at]
    return p, q, depth


def _descending(rows: DataFrame, group, depths: range, least: int, divergence: float) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        gram, n, p, q, depth = (t.column(c).to_numpy() for c in ("gram", "n", "p", "q", "depth"))
        p, q, depth = descend(gram, n, p, q, depth, depths, least, divergence)
        return pa.table({"gram": gram, "n": n, "p": p, "q": q, "depth": depth.astype(np.int32)})

    kept = rows.select("gram", "n", "p", "q", "depth", group.alias("part"))
    return kept.groupBy("part").applyInArrow(run, "gram bigint, n bigint, p double, q double, depth int")


def probabilities(grams: DataFrame, least: int = LEAST, divergence: float = DIVERGENCE) -> DataFrame:
    """gram, n, p, q, depth of distinct `grams(gram, n)`: the probability of the last byte after the longest
    suffix of the others that stays in the tree, which has `depth` bytes."""
    low = written(
        grams.groupBy(F.lit(_suffix(-1, LOW)).bitwiseAND(F.col("gram")).alias("gram")).agg(F.sum("n").alias("n")),
        "low",
    )
    root = np.zeros(SYMBOLS, np.int64)
    for r in low.groupBy(F.col("gram").bitwiseAND(SYMBOLS - 1).alias("next")).agg(F.sum("n").alias("n")).collect():
        root[r.next] = r.n  # SYMBOLS rows at most
    shares, total = (root + 1) / (root.sum() + SYMBOLS), max(1, int(root.sum()))
    next_byte = (F.col("gram").bitwiseAND(SYMBOLS - 1) + 1).cast("int")

    def of_root(values) -> F.Column:
        return F.element_at(F.array(*map(F.lit, values.tolist())), next_byte)

    started = low.select(
        "gram", "n", of_root(shares).alias("p"), of_root(root / total).alias("q"), F.lit(0).alias("depth")
    )
    last = F.shiftright("gram", BITS).bitwiseAND(SYMBOLS - 1)
    wide = written(_descending(started, last, range(1, LOW + 1), least, divergence), "low_states")
    begun = grams.withColumn("low", F.col("gram").bitwiseAND(_suffix(-1, LOW))).join(
        wide.select(F.col("gram").alias("low"), "p", "q", "depth"), "low"
    )
    groups = max(1, grams.count() // GROUP_GRAMS)
    context = F.shiftright("gram", BITS).bitwiseAND((1 << BITS * (LOW + 1)) - 1)
    group = F.pmod(F.xxhash64(context), F.lit(groups))
    return _descending(begun, group, range(LOW + 1, DEPTH + 1), least, divergence)


# --- keys of blocks and what is known about them ----------------------------------------------------


class Keys(NamedTuple):
    """Columns of `blocks` that hold packed keys, and how these are read and dealt to buckets."""

    name: str
    size: str
    times: str
    kind: str
    pack: Callable[[np.ndarray], bytes]
    unpack: Callable[[bytes], np.ndarray]
    bucket: Callable[[np.ndarray, int], np.ndarray]


GRAMS = Keys("grams", "n_grams", "gram_times", "bigint", _pack_grams, _unpack_grams, _gram_bucket)
WORDS = Keys("words", "n_words", "word_times", "binary", _pack_words, _unpack_words, _word_bucket)


def counted(parts: DataFrame, keys: Keys) -> DataFrame:
    """Distinct (key, n) of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.int64() if keys.kind == "bigint" else pa.binary()
        for batch in batches:
            for data, times in zip(*batch.columns, strict=True):
                found, n = keys.unpack(data.as_py()), _unpack(times.as_py(), np.int64)
                for at in range(0, len(n), 1 << 15):
                    part = slice(at, at + (1 << 15))
                    yield pa.RecordBatch.from_arrays([pa.array(found[part], kind), pa.array(n[part])], names=["key", "n"])

    packed = parts.filter(F.col(keys.name).isNotNull()).select(keys.name, keys.times)
    each = packed.mapInArrow(run, f"key {keys.kind}, n bigint")
    return written(each.groupBy("key").agg(F.sum("n").alias("n")), keys.name)


def gram_counts(parts: DataFrame) -> DataFrame:
    return counted(parts, GRAMS).withColumnRenamed("key", "gram")


def looked_up(parts: DataFrame, keys: Keys, known: DataFrame) -> DataFrame:
    """(block, keys, value): the keys of each block in some pieces, with the numbers that `known(key, value)` has
    for them."""
    packed = parts.filter(F.col(keys.name).isNotNull())
    total = packed.agg(F.coalesce(F.sum(keys.size), F.lit(0))).first()[0]
    buckets = max(1, total // BUCKET_KEYS) | 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(*batch.columns, strict=True):
                own = keys.unpack(data.as_py())
                bucket = keys.bucket(own, buckets)
                order = np.argsort(bucket, kind="stable")
                used, first = np.unique(bucket[order], return_index=True)
                pieces = [keys.pack(k) for k in np.split(own[order], first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.as_py()] * len(used), pa.int64()), pa.array(used), pa.array(pieces, pa.binary())],
                    names=["block", "bucket", keys.name],
                )

    def look_up(asked: pa.Table, known: pa.Table) -> pa.Table:
        key = known.column("key")
        where = pd.Index(key.to_numpy() if keys.kind == "bigint" else key.to_pylist(), dtype=key.type.to_pandas_dtype())
        value = known.column("value").to_numpy()
        values = [_pack(value[where.get_indexer(keys.unpack(k.as_py()))]) for k in asked.column(keys.name)]
        columns = {"block": asked.column("block"), keys.name: asked.column(keys.name)}
        return pa.table({**columns, f"{keys.name}_value": pa.array(values, pa.binary())})

    asked = packed.select("block", keys.name).mapInArrow(deal, f"block bigint, bucket bigint, {keys.name} binary")
    hashed = F.col("key") if keys.kind == "bigint" else F.crc32("key")
    dealt = known.select("key", "value", F.pmod(hashed, F.lit(buckets)).alias("bucket"))
    return (
        asked.groupBy("bucket")
        .cogroup(dealt.groupBy("bucket"))
        .applyInArrow(look_up, f"block bigint, {keys.name} binary, {keys.name}_value binary")
    )


# --- scoring --------------------------------------------------------------------------------------


def score_documents(docs: DataFrame, least: int = LEAST, divergence: float = DIVERGENCE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learns from rows whose id's crc32 is not 0 modulo 10 (a null id counts as the empty text and
    is held out).  Null texts count as empty: one token, the end.  Texts are read whole; equal texts
    get equal scores; repeated rows stay and count; other columns are ignored; no rows give no
    rows.  Without training rows all base scores are 0 and the tree is uniform.
    """
    fed = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (id_crc() % 10 == 0).alias("held"),
        whole_text().cast("binary").alias("body"),
    )
    parts = blocks(fed)
    words = counted(parts, WORDS)
    n_words, n_tokens = words.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    values = probabilities(gram_counts(parts), least, divergence)
    shares = values.select(F.col("gram").alias("key"), F.log10("p").cast("float").alias("value"))
    mixed = (
        parts.filter("texts IS NOT NULL")
        .select("block", "ids", "held", "texts")
        .unionByName(looked_up(parts, WORDS, words.withColumnRenamed("n", "value")), allowMissingColumns=True)
        .unionByName(looked_up(parts, GRAMS, shares), allowMissingColumns=True)
    )
    floor = n_tokens + 0.1 * (n_words + 1)

    def run(block: pa.Table) -> pa.Table:
        def given(name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
            unpack = {"words": _unpack_words, "grams": _unpack_grams}[name]
            rows = block.filter(block.column(name).is_valid())
            found = [unpack(k.as_py()) for k in rows.column(name)]
            numbers = [_unpack(v.as_py(), kind) for v in rows.column(f"{name}_value")]
            return np.concatenate(found), np.concatenate(numbers)

        words, c = given("words", np.int64)
        place = {w: i for i, w in enumerate(words.tolist())}
        base, there = np.log10((c + 0.1) / floor), c > 0
        grams, log = given("grams", np.float32)
        where, log = pd.Index(grams), log.astype(np.float64)
        out: dict[str, list] = {n: [] for n in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")}
        rows = block.filter(block.column("texts").is_valid())
        for ids, held, data in zip(*(rows.column(n) for n in ("ids", "held", "texts")), strict=True):
            texts = _whole(data.as_py()).split(bytes([END]))
            for text in texts:
                tokens = text.split()
                tokens.append(END_WORD)
                at = np.fromiter(map(place.__getitem__, tokens), np.int64, len(tokens))
                out["n_tokens"].append(len(at))
                out["n_known"].append(int(there[at].sum()))
                out["base_score"].append(float(base[at].sum()))
            found, start, end = _stream(texts)
            each = log[where.get_indexer(found)]  # places of padding get a wrong share, which is left out
            out["score"] += np.add.reduceat(each, np.column_stack([start, end]).ravel())[::2].tolist()
            out["doc_id"] += ids.as_py()
            out["held_out"] += held.as_py()
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        made = {name: pa.array(out[name], kind) for name, kind in zip(out, kinds, strict=True)}
        return pa.table({**made, "train_tokens": pa.array([n_tokens] * len(out["doc_id"]), pa.int64())}).select(
            [c.split()[0] for c in SCORED_DDL.split(", ")]
        )

    return mixed.groupBy("block").applyInArrow(run, SCORED_DDL)


SCORED_DDL = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
    "base_score double, score double"
)
