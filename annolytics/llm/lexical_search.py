"""Ranked lexical search with geometrically blocked posting lists.

The index is a written table with one row a document: its terms and how often each occurs.  A batch of
items is searched over slices of the index, a few thousand documents each.  In a slice a document is the
vector of its impacts, the exact integers that a term adds to a score.  The posting list of a term is
clustered by the similarity of its documents' vectors and cut into blocks; a block stores the largest impact
of every term among its documents.  Summed over an item's terms these give a bound that no document of
the block exceeds.  Blocks whose bound is below the worst score still wanted are skipped, the
others are scored in full, so results are exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annolytics.llm.common import free_names, whole_text, written

BEST = 10
SLICE_DOCUMENTS, SLICE_POSTINGS = 4_096, 500_000
BLOCK = 32  # documents
DIMENSIONS = 24  # of the sketches that say which documents are alike
TABLE_CELLS = 2_000_000  # of the table in which maxima are found
KEPT_MAXIMA = 4_000_000  # stored for a slice; lists are blocked anew beyond that
PROBED = 10  # times as many postings as results wanted are looked at for the first bar
BATCH_TERMS = 400_000  # terms of the items that are searched, and sent to the tasks, at once

# Bytes of a term stay, A-Z lower-cased; the rest are spaces.  Code points above 127 are all term bytes.
_TERM_BYTES = bytes(
    b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower()
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


# --- index ----------------------------------------------------------------------------------------


def _lists(values: pa.Array, sizes: list[int] | np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), values)


def forward(rows: DataFrame) -> DataFrame:
    """`rows(id, body)` as (id, n, terms, times): n terms with repeats, each distinct one and its occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts = [Counter(terms_of(t.as_py())) for t in part.column(1)]
                sizes = [len(c) for c in counts]
                terms = pa.array([t for c in counts for t in c], pa.binary()).cast(pa.string())
                times = pa.array([n for c in counts for n in c.values()], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([c.total() for c in counts], pa.int64()),
                        _lists(terms, sizes),
                        _lists(times, sizes),
                    ],
                    names=["id", "n", "terms", "times"],
                )

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, n bigint, terms array<string>, times array<int>")


def build_index(docs: DataFrame) -> DataFrame:
    """The written index (id, n, terms, times) of all rows; documents without a term have n = 0."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), whole_text().cast("binary").alias("body"))
    return written(forward(rows), "lexical-index")


def _flat(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, pa.Array]:
    """(row of each value, values) of a list column."""
    lists = batch.column(column)
    sizes = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(batch.num_rows), sizes), lists.flatten()


def _postings(index: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """(id, n, terms, times) with the terms of the vocabulary only, as their places in it, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, terms = _flat(batch, "terms")
            place = pc.index_in(terms, value_set=vocabulary)
            hit = place.is_valid()
            times = _flat(batch, "times")[1].filter(hit)
            sizes = np.bincount(row[hit.to_numpy(zero_copy_only=False)], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n"), _lists(place.drop_null(), sizes), _lists(times, sizes)],
                names=["id", "n", "terms", "times"],
            )

    return written(index.mapInArrow(run, "id bigint, n bigint, terms array<int>, times array<int>"), "lexical-postings")


def _frequencies(postings: DataFrame, width: int) -> np.ndarray:
    """In how many documents each term of the vocabulary occurs."""
    rows = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    found = np.zeros(width, np.int64)
    for row in rows.collect():  # a row a term of the batch at most
        found[row["term"]] = row["df"]
    return found


# --- blocks ---------------------------------------------------------------------------------------


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), then those of starts[1], ..."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Blocks:
    """One posting list, cut into blocks of documents alike."""

    def __init__(self, documents: np.ndarray, sketch: np.ndarray, slice_: Slice):
        count = -(-len(documents) // BLOCK)
        place = np.zeros(len(documents), np.int64)
        if count > 1:
            centres = documents[np.linspace(0, len(documents) - 1, count).astype(np.int64)]
            nearest = (sketch[documents] @ sketch[centres].T).argmax(axis=1)
            order = np.argsort(nearest, kind="stable")
            documents, nearest = documents[order], nearest[order]
            first = np.flatnonzero(np.r_[True, nearest[1:] != nearest[:-1]])
            inside = np.arange(len(nearest)) - np.repeat(first, np.diff(np.r_[first, len(nearest)]))
            place = np.cumsum(np.r_[False, (nearest[1:] != nearest[:-1]) | (inside[1:] % BLOCK == 0)])
        self.documents, self.place = documents, place
        # the coordinatewise maximum: of each block and term the largest impact
        width, found = slice_.width, []
        step = max(1, TABLE_CELLS // width)
        for low in range(0, int(place[-1]) + 1, step):
            here = slice(*np.searchsorted(place, (low, low + step)))
            at, sizes = slice_.postings(documents[here])
            table = np.zeros((int(place[here][-1]) - low + 1, width), np.int64)
            np.maximum.at(table.ravel(), np.repeat(place[here] - low, sizes) * width + slice_.terms[at], slice_.impacts[at])
            stored = table > 0
            stored[:, 0] = True  # no block without an entry
            block, terms = np.nonzero(stored)
            found.append((block + low, terms, table[block, terms]))
        block, self.terms, self.maxima = (np.concatenate(f) for f in zip(*found, strict=True))
        self.starts = np.searchsorted(block, np.arange(place[-1] + 1))

    def bounds(self, wanted: np.ndarray) -> np.ndarray:
        """For each block a score that none of its documents exceeds."""
        return np.add.reduceat(self.maxima * wanted[self.terms], self.starts)


class Best:
    """The best documents of an item so far; equal scores by ascending id, null last."""

    def __init__(self, size: int, floor: int = 1):
        self.size, self.floor = size, floor
        self.scores, self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """A lower score is of no use."""
        return int(self.scores[-1]) if len(self.scores) == self.size else self.floor

    def offer(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        good = scores >= self.least
        scores, ids, null = (
            np.r_[old, new[good]]
            for old, new in ((self.scores, scores), (self.ids, ids), (self.null, null))
        )
        order = np.lexsort((ids, null, -scores))[: self.size]
        self.scores, self.ids, self.null = scores[order], ids[order], null[order]


class Slice:
    """Some documents' postings of the terms that are searched for, sorted by document."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, rows: np.ndarray, terms: np.ndarray,
                 impacts: np.ndarray, width: int):
        self.ids, self.null, self.terms, self.impacts, self.width = ids, null, terms, impacts, width
        self.starts = np.searchsorted(rows, np.arange(len(ids) + 1))
        order = np.argsort(terms, kind="stable")
        self.by_term = rows[order]
        self.list_starts = np.searchsorted(terms[order], np.arange(width + 1))
        self.peaks = np.zeros(width, np.int64)  # the largest impact in each list
        np.maximum.at(self.peaks, terms, impacts)
        signs = np.random.default_rng(1).choice(np.array([-1, 1], np.float32), (width, DIMENSIONS))
        self.sketch = np.zeros((len(ids), DIMENSIONS), np.float32)
        full = np.flatnonzero(np.diff(self.starts))
        scaled = (impacts / max(int(impacts.max(initial=1)), 1)).astype(np.float32)
        for d in range(DIMENSIONS):
            if len(full):
                self.sketch[full, d] = np.add.reduceat(scaled * signs[terms, d], self.starts[full])
        self.sketch /= np.maximum(np.linalg.norm(self.sketch, axis=1, keepdims=True), 1e-9)
        self.lists: dict[int, Blocks] = {}
        self.kept = self.scored = self.skipped = 0

    def postings(self, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the postings of these documents, how many each has)."""
        sizes = self.starts[documents + 1] - self.starts[documents]
        return _ranges(self.starts[documents], sizes), sizes

    def blocks(self, term: int) -> Blocks:
        """Made when first looked at: lists that no item needs cost nothing."""
        found = self.lists.get(term)
        if found is None:
            found = Blocks(self.by_term[self.list_starts[term] : self.list_starts[term + 1]], self.sketch, self)
            if self.kept > KEPT_MAXIMA:
                self.lists.clear()
                self.kept = 0
            self.lists[term] = found
            self.kept += len(found.maxima)
        return found

    def search(self, item: np.ndarray, best: Best, lists: int | None = None) -> None:
        """Add to `best` what this slice has for the distinct terms of an item.

        With `lists`, only documents of the lists of that many terms are looked at, the first of the item.
        """
        peaks = self.peaks[item]
        if lists is not None:
            peaks = np.where(np.arange(len(item)) < lists, peaks, 0)
        order = np.argsort(-peaks, kind="stable")
        wanted = np.zeros(self.width, np.int64)
        wanted[item] = 1
        seen = np.zeros(len(self.ids), bool)
        # a document with none of the terms so far scores at most what the lists ahead can add
        ahead = np.cumsum(self.peaks[item][order][::-1])[::-1]
        for place, most in zip(order.tolist(), ahead.tolist(), strict=True):
            if most < best.least or not peaks[place]:
                break
            blocks = self.blocks(int(item[place]))
            alive = blocks.bounds(wanted) >= best.least
            self.skipped += int((~alive).sum())
            chosen = blocks.documents[alive[blocks.place]]
            chosen = chosen[~seen[chosen]]
            if not len(chosen):
                continue
            seen[chosen] = True
            self.scored += len(chosen)
            at, sizes = self.postings(chosen)
            scores = np.add.reduceat(self.impacts[at] * wanted[self.terms[at]], np.cumsum(sizes) - sizes)
            best.offer(scores, self.ids[chosen], self.null[chosen])


# --- search ---------------------------------------------------------------------------------------


def impacts(times: np.ndarray, lengths: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return weights * ((1_000_000_000 * times) // (1000 * times + 8 * lengths))


def _best_of_tasks(
    postings: DataFrame, items: list[np.ndarray], weights: np.ndarray, documents: int, total: int, size: int,
    lists: list[int] | None = None, floors: list[int] | None = None,
) -> DataFrame:
    """(item, id, score): of every task and item (terms, rarest first) the best documents.

    `lists` restricts each item to its first terms' lists; scores below its floor are of no use.
    """

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
        parts: list[tuple] = []
        rows = found = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                row, terms = _flat(part, "terms")
                terms = terms.to_numpy().astype(np.int64)
                times = _flat(part, "times")[1].to_numpy().astype(np.int64)
                length = np.array([10 + 90 * n * documents // total for n in part.column("n").to_pylist()], np.int64)
                ids = part.column("id")
                parts.append(
                    (
                        ids.fill_null(0).to_numpy(),
                        ids.is_null().to_numpy(zero_copy_only=False),
                        row + rows,
                        terms,
                        impacts(times, length[row], weights[terms]),
                    )
                )
                rows += part.num_rows
                found += len(row)
                if rows >= SLICE_DOCUMENTS or found >= SLICE_POSTINGS:
                    yield Slice(*(np.concatenate(p) for p in zip(*parts, strict=True)), len(weights))
                    parts, rows, found = [], 0, 0
        if parts:
            yield Slice(*(np.concatenate(p) for p in zip(*parts, strict=True)), len(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the best of earlier slices raise the bar for later ones
        best = [Best(size, floors[i] if floors else 1) for i in range(len(items))]
        for part in slices(batches):
            for i, item in enumerate(items):
                part.search(item, best[i], lists[i] if lists else None)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(len(items)), [len(b.ids) for b in best])),
                pa.array(np.concatenate([b.ids for b in best]), mask=np.concatenate([b.null for b in best])),
                pa.array(np.concatenate([b.scores for b in best])),
            ],
            names=["item", "id", "score"],
        )

    return postings.mapInArrow(run, "item bigint, id bigint, score bigint")


def _ranked(best: DataFrame, size: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


def _search_batch(
    index: DataFrame, items: list[tuple[int, list[str]]], documents: int, total: int, size: int
) -> DataFrame:
    """(item, id, rank, score) of some items, each a number and its terms.

    The lists of each item's rarest terms are searched first.  The last score they give is one that the
    result reaches anyway, so the search of all lists starts with it as its bar.
    """
    vocabulary = pa.array(sorted({t for _, terms in items for t in terms}), pa.string())
    place = {t: i for i, t in enumerate(vocabulary.to_pylist())}
    postings = _postings(index, vocabulary)
    df = _frequencies(postings, len(vocabulary))
    weights = np.array([weight(documents, n) for n in df.tolist()], np.int64)
    asked = [np.array([place[t] for t in terms], np.int64) for _, terms in items]
    asked = [terms[np.lexsort((terms, df[terms]))] for terms in asked]
    rare = [int(np.searchsorted(np.cumsum(df[terms]), PROBED * size)) + 1 for terms in asked]
    probed = _ranked(_best_of_tasks(postings, asked, weights, documents, total, size, lists=rare), size)
    floors = [1] * len(items)
    for row in probed.filter(F.col("rank") == size).collect():  # a row an item at most
        floors[row["item"]] = row["score"]
    numbers = index.sparkSession.createDataFrame([(i, n) for i, (n, _) in enumerate(items)], "item bigint, number bigint")
    found = _ranked(_best_of_tasks(postings, asked, weights, documents, total, size, floors=floors), size)
    return found.join(F.broadcast(numbers), "item").select(F.col("number").alias("item"), "id", "rank", "score")


def search(index: DataFrame, items: DataFrame, size: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its best documents with a score above 0, best first,
    equal scores by ascending id (null last).

    An item is an id; the terms of its rows count once each.  Rows of the index are documents each, also
    with one id; null texts and texts without a term score nothing, and no documents or items
    give no rows.  Items are searched in batches of a bounded number of terms, whatever their number.
    """
    spark = index.sparkSession
    (position,) = free_names(items, "_number")
    total = index.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.sum("n").alias("total")).first()
    asked = forward(items.select(F.col("item_id").alias("id"), whole_text().cast("binary").alias("body")))
    terms = asked.select("id", F.explode("terms").alias("term")).groupBy("id").agg(F.collect_set("term").alias("terms"))
    # numbers are a hash of the id, so a batch is a part of the items that any retry finds again
    numbered = written(terms.withColumn(position, F.xxhash64("id")), "lexical-items")
    asked_terms = numbered.agg(F.sum(F.size("terms"))).first()[0]
    batches = math.ceil((asked_terms or 0) / BATCH_TERMS) if total["documents"] else 0
    found = []
    for batch in range(batches):
        rows = numbered.filter(F.pmod(F.col(position), F.lit(batches)) == batch).select(position, "terms").collect()
        if rows:
            found.append(written(
                _search_batch(index, [tuple(r) for r in rows], total["documents"], total["total"], size), "lexical-best"
            ))
    best = spark.createDataFrame([], "item bigint, id bigint, rank int, score bigint")
    for part in found:
        best = best.unionByName(part)
    names = numbered.select(F.col(position).alias("item"), F.col("id").alias("item_id"))
    return best.join(names, "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")
