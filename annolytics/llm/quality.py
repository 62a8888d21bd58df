"""Quality classifier: supervised subword embeddings.

Every word has hashed features: itself, its character trigrams, and whether it repeats one of the two
words before it.  Features have learned vectors, a document is their average, and a softmax layer
turns it into class probabilities.  Vectors and layer are trained together by stochastic gradient
descent in numpy on a bounded, balanced sample.

The average and the layer are linear, so for scoring each feature's vector is folded with the layer
into one number: its contribution to the log-odds of class 1.  The folded table (one float per hash
bucket) is what tasks get; its size is fixed.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.llm.common import extended, free_names, id_crc, whole_text

BUCKETS = 1 << 15  # the last LAGS buckets are the repeat features
LAGS = (1, 2)
DIMENSION = 16
SAMPLE_PER_CLASS = 1_000
EPOCHS = 6
THRESHOLD = 0.7
CACHED_WORDS = 200_000


def word_features(word: bytes) -> list[int]:
    """Buckets of a word: itself and the trigrams of <word>; 1 + len(word) of them."""
    framed, size = b"<" + word + b">", BUCKETS - len(LAGS)
    return [crc32(framed) % size, *(crc32(framed[i : i + 3]) % size for i in range(len(word)))]


def repeats(words: list[bytes]) -> list[int]:
    """How many words equal the one 1 (2) places before."""
    return [sum(map(operator.eq, words, islice(words, lag, None))) for lag in LAGS]


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how often each occurs."""
    words = text.split()
    counts = np.bincount([f for w in words for f in word_features(w)], minlength=BUCKETS)
    for lag, n in zip(LAGS, repeats(words), strict=True):
        counts[BUCKETS - lag] += n
    ids = np.flatnonzero(counts)
    return ids.astype(np.int32), counts[ids].astype(np.int32)


@dataclass
class Model:
    contribution: np.ndarray  # per bucket, to the log-odds of class 1
    bias: float

    def probability(self, total: float, features: int) -> float:
        z = self.bias + (total / features if features else 0.0)
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 1) -> Model:
    """SGD, one document a step, both classes weighing the same.  Without both classes the model
    gives the share of class 1 (0.5 without documents) to every text."""
    share = float(np.mean(labels)) if len(labels) else 0.5
    if not len(labels) or share in (0.0, 1.0):
        odds = math.log((share * len(labels) + 1) / ((1 - share) * len(labels) + 1))
        return Model(np.zeros(BUCKETS), odds)
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSION))
    layer, bias = rng.normal(0, 0.1, (DIMENSION, 2)), np.zeros(2)
    weight = 0.5 / np.array([1 - share, share])
    steps, done = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            ids, counts = bags[i]
            rate = 0.5 * (1 - done / steps)
            done += 1
            part = counts / max(counts.sum(), 1)
            mean = part @ vectors[ids]
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= weight[labels[i]] * rate
            back = layer @ p
            layer -= np.outer(mean, p)
            bias -= p
            # the mean spreads the gradient thinly over many features, so vectors learn faster
            vectors[ids] -= 20 * part[:, None] * back
    return Model(vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))


def sampled(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(doc_id, quality, ids, counts): the bags to learn from, one for each id however often it is repeated."""
    usable = (
        labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)")
        .filter(id_crc() % 4 != 2)
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    texts = docs.select("doc_id", whole_text().cast("binary").alias("text"))
    # ids first: texts of the sample only are read into the join
    known = usable.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = known.filter("quality = 0").orderBy(*order).limit(per_class).unionAll(
        known.filter("quality = 1").orderBy(*order).limit(per_class)
    )

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bag(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([i.tobytes() for i, _ in found], pa.binary()),
                    pa.array([c.tobytes() for _, c in found], pa.binary()),
                ],
                names=["doc_id", "quality", "ids", "counts"],
            )

    return (
        texts.join(F.broadcast(picked), "doc_id")  # at most 2 * per_class ids
        .select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
        .mapInArrow(bags, "doc_id bigint, quality int, ids binary, counts binary")
        .groupBy("doc_id", "quality")
        .agg(F.min(F.struct("ids", "counts")).alias("bag"))
        .select("doc_id", "quality", "bag.*")
    )


def learn(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model from up to `per_class` labelled documents of each class, picked by a hash of the id.

    Rows whose id's crc32 leaves 2 modulo 4 are held out.  Texts are turned into bags in the tasks;
    the driver gets at most 2 * `per_class` bags of at most BUCKETS entries.  A repeated label or
    id counts once (the smallest label, the smallest bag); null ids and labels are left out.
    """
    rows = sorted(sampled(docs, labels, per_class).collect(), key=lambda r: r["doc_id"])
    return train(
        [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["counts"], np.int32)) for r in rows],
        np.array([r["quality"] for r in rows], int),
    )


class Scorer(dict):
    """word -> its contribution, computed once; emptied when it holds too many words."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.table = model, model.contribution.tolist()

    def __missing__(self, word: bytes) -> float:
        self[word] = value = sum(self.table[f] for f in word_features(word))
        return value

    def score(self, text: bytes) -> float:
        if len(self) > CACHED_WORDS:
            self.clear()
        words = text.split()
        total = sum(map(self.__getitem__, words))
        features = len(words) + sum(map(len, words))
        for lag, n in zip(LAGS, repeats(words), strict=True):
            total += n * self.table[BUCKETS - lag]
            features += n
        return self.model.probability(total, features)


def with_scores(docs: DataFrame, model: Model, column: str = "text", out: str = "score") -> DataFrame:
    """`docs` with one more column (last; its name is lengthened if taken): the probability of
    class 1.  Null texts count as empty and get the model's bias; very long texts are read whole;
    other columns pass through; no rows give no rows."""
    out, body = free_names(docs, out, "_body")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            last = batch.num_columns - 1
            scores = [scorer.score(t.as_py()) for t in batch.column(last)]
            arrays = [*batch.columns[:last], pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:last], out])

    fed = docs.withColumn(body, whole_text(column).cast("binary"))
    return fed.mapInArrow(score, extended(docs, out, "double"))
