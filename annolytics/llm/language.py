"""Language identification with segmentation-marginalised unigrams.

Words are runs of letters, lower-cased, with the vocabulary's mark for a word's start.  A word can be cut into
pieces of a fixed public vocabulary in many ways.  Each language has a probability for every piece; the
probability of a word is the sum over all its segmentations, which a forward pass over its letters gives, and
that of a text the product over its words.  Piece probabilities are learned by expectation
maximisation: forward and backward passes over the counted words of a bounded sample give the expected
occurrences of each piece.  Words are counted, and expectations summed, by Spark.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.llm.common import extended, free_names, id_crc, whole_text, written

PER_LANGUAGE = 500  # documents to learn from: about so many, picked by a hash of the id
BROADCAST_IDS = 200_000
ROUNDS = 4
ADDED = 0.01  # to every piece's expected occurrences
LONGEST_LEARNED = 28  # letters; longer words are scored, not learned from
RESCALED = 16  # letters between two rescalings; no piece is longer
WORDS_AT_ONCE = 20_000
CHARACTERS_AT_ONCE = 1_000_000
CACHED_WORDS = 300_000  # that a worker remembers; then it starts afresh
UNDETERMINED = "und"
START = "▁"
UNKNOWN = 0  # piece of a letter that the vocabulary lacks

_LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def read_pieces(path: str) -> dict[str, int]:
    """piece -> number, of a vocabulary file: those of lower-case letters, with or without the start mark."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        letters = piece.removeprefix(START)
        if len(piece) <= RESCALED and (not letters or _LETTERS.fullmatch(letters)) and letters == letters.lower():
            found.setdefault(piece, len(found) + 1)
    return found


# --- segmentations --------------------------------------------------------------------------------


class Segmenter:
    def __init__(self, pieces: dict[str, int]):
        self.pieces = pieces
        self.size = len(pieces) + 1
        self.longest = max(map(len, pieces), default=1)

    def arcs(self, words: list[str]) -> np.ndarray:
        """Pieces that may cover each stretch of words of one length, as (word, stretch); `size` for none.

        Stretches are ordered by their end, then their length.
        """
        get, none, n = self.pieces.get, self.size, len(words[0]) + 1
        cuts = [slice(end - k, end) for end in range(1, n + 1) for k in range(1, min(self.longest, end) + 1)]
        single = [c.stop - c.start == 1 for c in cuts]
        missing = [UNKNOWN if s else none for s in single]
        return np.array(
            [[get(w[c], m) for c, m in zip(cuts, missing, strict=True)] for w in (START + w for w in words)], np.int32
        )

    def by_end(self, letters: int) -> list[tuple[int, int]]:
        """(first stretch, number of stretches) for each end."""
        sizes = [min(self.longest, end) for end in range(1, letters + 2)]
        return [(sum(sizes[:i]), s) for i, s in enumerate(sizes)]

    def log_probabilities(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """(word, language): log of the sum over all segmentations.  `table` is (piece, language), its
        last row zero; the words have one length."""
        arcs = self.arcs(words)
        logs = np.zeros((len(words), table.shape[1]))
        window = [np.ones((len(words), table.shape[1]))]  # forward sums of the last ends, newest last
        for end, (first, count) in enumerate(self.by_end(len(words[0])), start=1):
            total = sum(window[-k] * table[arcs[:, first + k - 1]] for k in range(1, count + 1))
            window = [*window[-self.longest + 1 :], total] if self.longest > 1 else [total]
            if end % RESCALED == 0:
                window = [w / total for w in window]
                logs += np.log(total)
        return logs + np.log(window[-1])

    def expected(self, words: list[str], weights: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Expected occurrences of each piece in words of one length and one language; `table` is (piece,)."""
        arcs, ends = self.arcs(words), self.by_end(len(words[0]))
        n = len(ends)
        forward, backward = np.zeros((n + 1, len(words))), np.zeros((n + 1, len(words)))
        forward[0] = backward[n] = 1
        p = table[arcs]
        for end in range(1, n + 1):
            first, count = ends[end - 1]
            forward[end] = sum(forward[end - k] * p[:, first + k - 1] for k in range(1, count + 1))
        for end in range(n, 0, -1):
            first, count = ends[end - 1]
            for k in range(1, count + 1):
                backward[end - k] += backward[end] * p[:, first + k - 1]
        share = weights / forward[n]
        found = np.zeros(self.size + 1)
        for end in range(1, n + 1):
            first, count = ends[end - 1]
            for k in range(1, count + 1):
                use = forward[end - k] * p[:, first + k - 1] * backward[end] * share
                found += np.bincount(arcs[:, first + k - 1], use, self.size + 1)
        return found[: self.size]


def _by_length(words: list[str]) -> Iterator[np.ndarray]:
    """Places of words of one length, a bounded number at a time."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        step = max(1, WORDS_AT_ONCE // max(1, int(lengths[group[0]]) // 8)) if len(group) else 1
        for at in range(0, len(group), step):
            yield group[at : at + step]


# --- learning -------------------------------------------------------------------------------------


@dataclass
class Model:
    pieces: dict[str, int]
    languages: list[str]  # sorted
    table: np.ndarray  # (piece, language) probabilities and a row of zeros


def sampled(docs: DataFrame, per_language: int) -> DataFrame:
    """(lang, text) of about `per_language` documents of each language, one row an id.

    Ids are sampled first, by a hash held against the share wanted, so only texts of the sample move.
    """
    usable = docs.filter(F.col("lang").isNotNull() & (id_crc() % 4 != 2)).select(
        F.col("lang").cast("string").alias("lang"), "doc_id", whole_text().alias("text")
    )
    ids = usable.select("lang", "doc_id").distinct()
    sizes = ids.groupBy("lang").agg(F.count("*").alias("size"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("language"), "doc_id"), 11) / F.lit(float(1 << 53))
    chosen = ids.join(sizes, "lang").filter(draw * F.col("size") < per_language).select("lang", F.col("doc_id").alias("id"))
    # some languages' worth of ids go to every task; more are joined by a shuffle
    chosen = written(chosen, "language-ids")
    if chosen.count() <= BROADCAST_IDS:
        chosen = F.broadcast(chosen)
    same = (usable["lang"] == chosen["lang"]) & usable["doc_id"].eqNullSafe(chosen["id"])
    return usable.join(chosen, same, "left_semi").groupBy("lang", "doc_id").agg(F.min("text").alias("text")).drop("doc_id")


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of `texts(lang, text)`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts.update((lang, w) for w in words_of(text.as_py()) if len(w) <= LONGEST_LEARNED)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in counts], pa.string()),
                    pa.array([k[1] for k in counts], pa.string()),
                    pa.array(list(counts.values()), pa.int64()),
                ],
                names=["lang", "word", "n"],
            )

    rows = texts.mapInArrow(run, "lang string, word string, n bigint")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _expected(words: DataFrame, model: Model) -> DataFrame:
    """(lang, piece, n): expected occurrences in `words(lang, word, n)` under the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(model.pieces)
        total = np.zeros((len(model.languages), segmenter.size))
        for batch in batches:
            lang, word = (np.array(batch.column(i).to_pylist(), object) for i in range(2))
            n = batch.column(2).to_numpy().astype(float)
            for i, name in enumerate(model.languages):
                here = np.flatnonzero(lang == name)
                mine = word[here].tolist()
                if mine:
                    for group in _by_length(mine):
                        total[i] += segmenter.expected([mine[k] for k in group], n[here[group]], model.table[:, i])
        i, piece = np.nonzero(total)
        names = [model.languages[k] for k in i]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(piece), pa.array(total[i, piece])], names=["lang", "piece", "n"]
        )

    return words.mapInArrow(run, "lang string, piece bigint, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, path: str, per_language: int = PER_LANGUAGE, rounds: int = ROUNDS) -> Model:
    """Piece probabilities of each non-null lang, from documents whose id's crc32 does not leave 2 modulo 4.

    The driver gets one number a language and piece; a language without a word learned has all pieces alike.
    """
    pieces = read_pieces(path)
    texts = written(sampled(docs, per_language), "language-texts")
    languages = sorted(r["lang"] for r in texts.select("lang").distinct().collect())
    words = written(word_counts(texts), "language-words")
    size = len(pieces) + 1

    def table(expected: np.ndarray) -> np.ndarray:
        p = (expected + ADDED) / (expected + ADDED).sum(axis=0, keepdims=True)
        return np.vstack([p, np.zeros((1, len(languages)))])

    model = Model(pieces, languages, table(np.zeros((size, len(languages)))))
    place = {name: i for i, name in enumerate(languages)}
    for _ in range(rounds if languages else 0):
        found = np.zeros((size, len(languages)))
        for lang, piece, n in sorted(map(tuple, _expected(words, model).collect())):
            found[piece, place[lang]] = round(n, 6)  # sums differ in the last digits from run to run
        model = Model(pieces, languages, table(found))
    return model


# --- scoring --------------------------------------------------------------------------------------


class Scorer:
    """Log-probabilities of texts; those of words are computed once and remembered."""

    def __init__(self, model: Model):
        self.model, self.segmenter = model, Segmenter(model.pieces)
        self.known: dict[str, int] = {}
        self.logs = np.zeros((0, len(model.languages)))

    def _meet(self, words: set[str]) -> None:
        if len(self.known) > CACHED_WORDS:
            self.known, self.logs = {}, self.logs[:0]
        new = sorted(w for w in words if w not in self.known)
        if not new:
            return
        logs = np.empty((len(new), self.logs.shape[1]))
        for group in _by_length(new):
            logs[group] = self.segmenter.log_probabilities([new[i] for i in group], self.model.table)
        self.known.update(zip(new, range(len(self.logs), len(self.logs) + len(new)), strict=True))
        self.logs = np.concatenate([self.logs, logs])

    def guess(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, posterior probability) of each text, all languages alike beforehand."""
        words = [words_of(t) for t in texts]
        self._meet(set(chain.from_iterable(words)))
        known, found = self.known, []
        for text in words:
            if not text or not self.model.languages:
                found.append((UNDETERMINED, 0.0))
                continue
            logs = self.logs[[known[w] for w in text]].sum(axis=0)
            best = int(logs.argmax())
            found.append((self.model.languages[best], float(1 / np.exp(logs - logs[best]).sum())))
        return found


def with_languages(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """`docs` with `lang_pred` and `score` last (names lengthened if taken).

    A null text or one without a letter is `und` with score 0, and so is every text if nothing was learned;
    texts are read whole, however long; equal probabilities go to the language that sorts first.
    """
    pred, score, body = free_names(docs, "lang_pred", "score", "_body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            last, found, texts, size = batch.num_columns - 1, [], [], 0
            for value in batch.column(last):
                texts.append(value.as_py())
                size += len(texts[-1])
                if size > CHARACTERS_AT_ONCE:
                    found += scorer.guess(texts)
                    texts, size = [], 0
            found += scorer.guess(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:last],
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                names=[*batch.schema.names[:last], pred, score],
            )

    fields = extended(docs, pred, "string").add(score, "double")
    return docs.withColumn(body, whole_text(column)).mapInArrow(run, fields)
