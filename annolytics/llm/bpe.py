"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token is a linked list of token ids.  Every merge rank has a bucket of list positions; a bitmap
of two levels says which buckets hold something, and find-first-set gives the lowest rank.  Entries
whose pair has changed meanwhile are stale and skipped.  The cost of a pre-token of n bytes is
O(n log n) however long it is.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.llm.common import whole_text

WORD = 256  # bits of a bitmap word
CACHED_CHUNKS, CACHED_PIECES = 600_000, 1_000_000  # that a worker remembers; then it starts afresh
CACHED_LENGTH = 48  # longer pieces are not remembered


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """token -> rank, from lines of base64 and number."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pieces = regex.compile(pattern)
        self.bitmap = [0] * (max(ranks.values()) // WORD + 1)  # all zero between two merges
        # (left id, right id) -> merged id
        self.merges = {
            (left, right): i
            for t, i in ranks.items()
            for k in range(1, len(t))
            if (left := ranks.get(t[:k])) is not None and (right := ranks.get(t[k:])) is not None
        }

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        merge, bitmap, n = self.merges.get, self.bitmap, len(piece)
        ids: list[int] = [self.single[b] for b in piece]  # -1: taken by the token on its left
        after = [*range(1, n), -1]
        before = [*range(-1, n - 1)]
        buckets: dict[int, list[int]] = {}  # rank -> heap of positions
        top = 0  # a bit for each word of the bitmap that is not zero

        for i, rank in enumerate(map(merge, zip(ids, ids[1:], strict=False))):
            if rank is None:
                continue
            if rank in buckets:
                buckets[rank].append(i)  # ascending, so a heap already
            else:
                buckets[rank] = [i]
                w, bit = divmod(rank, WORD)
                bitmap[w] |= 1 << bit
                top |= 1 << w

        while top:
            w = (top & -top).bit_length() - 1  # find first set, twice
            word = bitmap[w]
            rank = w * WORD + (word & -word).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                bitmap[w] = word = word & (word - 1)
                if not word:
                    top &= top - 1
            j = after[i]
            if j < 0 or merge((ids[i], ids[j])) != rank:
                continue  # stale; a taken position has id -1, which merges with nothing
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            h = before[i]
            for at, pair in ((i, (rank, ids[k]) if k >= 0 else None), (h, (ids[h], rank) if h >= 0 else None)):
                new = merge(pair)
                if new is None:
                    continue
                if new in buckets:
                    heappush(buckets[new], at)
                else:
                    buckets[new] = [at]
                    w, bit = divmod(new, WORD)
                    bitmap[w] |= 1 << bit
                    top |= 1 << w
            if k >= 0:
                before[k] = i
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pieces.findall(text) for i in self.merge(p.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Coder:
    """Encodes whole texts chunk by chunk, remembering what it has seen.

    A single space between two other non-spaces always begins a pre-token, so a text may be cut
    there, and a chunk encodes alike wherever it stands.
    """

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.tokens = {str(i): t for i, t in bpe.tokens.items()}
        self.chunks: dict[str, str] = {}  # chunk -> its ids as text
        self.pieces: dict[str, str] = {}
        self.spaced = re.compile(r"\s | \s")
        self.cut = regex.compile(r"(?<=\S) (?=\S)")

    def _chunk(self, chunk: str) -> str:
        parts = []
        for p in self.bpe.pieces.findall(chunk):
            known = self.pieces.get(p)
            if known is None:
                known = " ".join(map(str, self.bpe.merge(p.encode())))
                if len(p) <= CACHED_LENGTH:
                    self.pieces[p] = known
            parts.append(known)
        said = " ".join(parts)
        if len(chunk) <= CACHED_LENGTH:
            self.chunks[chunk] = said
        return said

    def encode(self, text: str) -> str:
        """Decimal ids joined by one space."""
        if not text:
            return ""
        if len(self.chunks) > CACHED_CHUNKS:
            self.chunks.clear()
        if len(self.pieces) > CACHED_PIECES:
            self.pieces.clear()
        if self.spaced.search(text) or text[0] == " " or text[-1] == " ":
            first, *rest = self.cut.split(text)
        else:
            first, *rest = text.split(" ")
        chunks = [first, *[" " + c for c in rest]]
        said = list(map(self.chunks.get, chunks))
        for at, known in enumerate(said):
            if known is None:
                said[at] = self._chunk(chunks[at])
        return " ".join(said)


@lru_cache(maxsize=1)
def coder_of(ranks: bytes, pattern: str) -> Coder:
    """A Python worker keeps its coder, and what it remembers, from one task to the next."""
    return Coder(Bpe(parse_ranks(ranks), pattern))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (decimal, joined by one space), decoded (bytes, from the ids) of every row.

    Null and empty texts have no ids; texts are encoded whole, however long; repeated rows stay,
    other columns are ignored, no rows give no rows.  The rank file is read on the driver and sent
    along: a vocabulary is of fixed size.
    """
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(ranks.value, pattern)
        tokens = coder.tokens
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [coder.encode(t.as_py()) for t in part.column(1)]
                back = [b"".join(map(tokens.__getitem__, said.split(" "))) if said else b"" for said in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.string()), pa.array(back, pa.binary())],
                    names=["doc_id", "ids", "decoded"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids string, decoded binary")
