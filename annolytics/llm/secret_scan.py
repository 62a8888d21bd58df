"""Secret scans with a trigram inverted index.

Each rule's regex is turned into a Boolean query over trigrams that every match must contain (all
letters folded to lower case).  A slice of documents gets a small inverted index holding only the
trigrams that some rule asks for; postings are intersected and united, and just the candidates are
verified with the regex.  A rule without mandatory trigrams verifies every document.  Everything
happens where the documents lie: no shuffle, no collect, memory bounded by the slice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.llm.common import extended, free_names, whole_text

SLICE_BYTES = 2 << 20
MAX_EXACT = 24  # strings that a sub-expression may stand for before they are cut into trigrams


@dataclass(frozen=True)
class Rule:
    """`group` of a match needs `least` characters; shorter matches are dropped, but still taken."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


# The base rules, in the order in which kinds are listed.  Letters of the first
# one's words may have either case (A-Z only, so no flag: it would let other letters in).
def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


ASSIGN = Rule(
    "assign",
    _either_case("(password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    6,
    2,
)
ACCESS = Rule("access", r"AKIA[A-Z0-9]+", 20)
HEX = Rule("hex", r"[0-9a-f]+", 24)
BASE = (ASSIGN, ACCESS, HEX)
# Further kinds.  A private key goes on to its END line, if no other BEGIN or END line comes first; else over
# header fields and base64 lines, also where line ends are escapes or lines are quoted.  Blank lines, and
# blanks within a line, are passed only before 16 base64 characters, so that prose is kept.
_LINE_END = (
    r"""(?:(?:[\x20\t]*(?:(?:\\r)?\\n)?[\x20\t"'+,]*(?:\r?\n|\r)|[\x20\t]*(?:\\r)?\\n)[\x20\t>"'#*]*)"""
)
_BASE64 = r"(?:[A-Za-z0-9+/]|\\/)"
_LAST = r"""(?=[\x20\t]*(?:[\r\n\\]|["'](?!\s*:)|-----|\Z))"""
_FIELD = rf"{_LINE_END}(?:[A-Z][A-Za-z]*-[A-Za-z-]+|Comment|Version):[^\n\r\\]*+"
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:"
    r"(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
    rf"|(?:(?:{_FIELD})++(?:{_LINE_END}(?={_LINE_END}))?+)?+"
    rf"(?:{_LINE_END}{_BASE64}++=*+{_LAST}"
    rf"|(?:{_LINE_END}|[\x20\t])*+{_BASE64}{{16,}}+=*+(?:[\x20\t]++{_BASE64}++=*+{_LAST})?+"
    rf"|[\x20\t]++{_BASE64}++=*+\Z)*+)"  # cut off within its first line
)
EXTRA = (
    Rule("private_key", PRIVATE_KEY),
    Rule("code_host", r"(?:ghp|gho|ghs|ghu|ghr)_[A-Za-z0-9]+", 40),
    Rule("chat_bot", r"xox[abprs]-[A-Za-z0-9-]+", 24),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE + EXTRA

# --- Boolean trigram queries ----------------------------------------------------------------------
# True: no demand.  bytes: one trigram.  ("and" | "or", frozenset of queries).


def both(*queries):
    return _combined("and", queries)


def either(*queries):
    return True if any(q is True for q in queries) else _combined("or", queries)


def _combined(kind: str, queries):
    parts: set = set()
    for q in queries:
        if q is not True:
            parts |= q[1] if isinstance(q, tuple) and q[0] == kind else {q}
    if not parts:
        return True
    return parts.pop() if len(parts) == 1 else (kind, frozenset(parts))


def _of_strings(strings: set[bytes]):
    """Any of these strings occurs."""
    return either(*(both(*(s[i : i + 3] for i in range(len(s) - 2))) for s in strings))


def _analyse(tree) -> tuple[set[bytes] | None, object]:
    """(all strings that the expression stands for, or None if too many; what a match demands)."""
    run, whole, demands = {b""}, True, []
    for kind, arg in tree:
        strings, demand = _node(kind, arg)
        demands.append(demand)
        if strings is not None and len(run) * len(strings) <= MAX_EXACT:
            run = {a + b for a in run for b in strings}
        else:
            demands.append(_of_strings(run))
            run, whole = strings or {b""}, False
    if whole:
        return run, both(*demands)
    return None, both(*demands, _of_strings(run))


def _node(kind, arg) -> tuple[set[bytes] | None, object]:
    if kind is op.LITERAL:
        return {chr(arg).encode().lower()}, True
    if kind is op.IN:
        chars: set[bytes] = set()
        for what, value in arg:
            if what is op.LITERAL:
                chars.add(chr(value).encode().lower())
            elif what is op.RANGE and value[1] - value[0] < 4 * MAX_EXACT:
                chars |= {chr(c).encode().lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, True
        return (chars, True) if len(chars) <= MAX_EXACT else (None, True)
    if kind is op.SUBPATTERN:
        return _analyse(arg[-1])
    if kind is op.BRANCH:
        found = [_analyse(x) for x in arg[1]]
        if all(strings is not None for strings, _ in found):
            strings = set().union(*(x for x, _ in found))
            if len(strings) <= MAX_EXACT:
                return strings, either(*(q for _, q in found))
        return None, either(*(both(q, _of_strings(x) if x is not None else True) for x, q in found))
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, inner = arg
        strings, demand = _analyse(inner)
        if low == 0:
            return (strings | {b""}, True) if high == 1 and strings is not None else (None, True)
        if strings is not None and high == low and len(strings) ** low <= MAX_EXACT:
            repeated = {b""}
            for _ in range(low):
                repeated = {a + b for a in repeated for b in strings}
            return repeated, demand
        return None, both(demand, _of_strings(strings) if strings is not None else True)
    if kind is op.AT:
        return {b""}, True
    return None, True  # anything else demands nothing


def trigram_query(pattern: str):
    """The query that every text with a match satisfies; True if the pattern demands nothing."""
    strings, demand = _analyse(parser.parse(pattern))
    return both(demand, _of_strings(strings)) if strings is not None else demand


def trigrams_of(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


# --- index and scan -------------------------------------------------------------------------------


def _code(trigram: bytes) -> int:
    return int.from_bytes(trigram, "big")


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.compiled = [re.compile(r.pattern) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.wanted = sorted(set().union(*map(trigrams_of, self.queries)))
        self.asked = np.zeros(1 << 24, np.uint8)
        self.asked[[_code(t) for t in self.wanted]] = 1

    def postings(self, texts: list[bytes]) -> dict[bytes, np.ndarray]:
        """trigram -> which of `texts` hold it, as a bitmap; only trigrams that rules ask for."""
        blob = np.frombuffer(b"\xff".join(texts).lower() + b"\xff\xff", np.uint8).astype(np.int32)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        codes = (blob[:-2] << 16) | (blob[1:-1] << 8) | blob[2:]
        at = np.flatnonzero(self.asked[codes])
        owner = np.searchsorted(starts, at, side="right") - 1
        found = codes[at]
        index = {}
        for t in self.wanted:
            index[t] = np.zeros(len(texts), bool)
            index[t][owner[found == _code(t)]] = True
        return index

    def _candidates(self, query, index, n: int) -> np.ndarray:
        if query is True:
            return np.ones(n, bool)
        if isinstance(query, bytes):
            return index[query]
        parts = [self._candidates(q, index, n) for q in query[1]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """Per text: (start, place of the kind in the list, end), in order; code points."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not texts:
            return found
        index = self.postings(texts)
        plain: dict[int, str] = {}
        for k, (rule, regex, query) in enumerate(zip(self.rules, self.compiled, self.queries, strict=True)):
            for i in np.flatnonzero(self._candidates(query, index, len(texts))).tolist():
                text = plain.get(i)
                if text is None:
                    text = plain[i] = texts[i].decode()
                for m in regex.finditer(text):
                    a, b = m.span(rule.group)
                    if b - a >= rule.least:
                        found[i].append((m.start(), k, m.end()))
        for spans in found:
            spans.sort()
        return found


def _slices(column: pa.Array) -> Iterator[list[bytes]]:
    part, held = [], 0
    for text in column.to_pylist():
        part.append(text)
        held += len(text)
        if held >= SLICE_BYTES:
            yield part
            part, held = [], 0
    if part:
        yield part


SPAN_TYPE = "array<struct<start:int,kind:string,end:int>>"
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))


def with_spans(docs: DataFrame, column: str = "text", out: str = "spans", rules: tuple[Rule, ...] = RULES):
    """`docs` with one more column: the secrets in `column`, by start, then kind as listed.

    Starts and ends are code points, ends exclusive.  Null and empty texts have none, very long
    texts are scanned whole, no rows give no rows; other columns pass through whatever their names
    (`out` is lengthened if taken; it is the last column).
    """
    out, body = free_names(docs, out, "_body")
    kinds = [r.kind for r in rules]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            last = batch.num_columns - 1
            spans = [
                [{"start": a, "kind": kinds[k], "end": b} for a, k, b in one]
                for part in _slices(batch.column(last))
                for one in scanner.scan(part)
            ]
            arrays = [*batch.columns[:last], pa.array(spans, _ARROW_SPANS)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:last], out])

    fed = docs.withColumn(body, whole_text(column).cast("binary"))
    return fed.mapInArrow(scan, extended(docs, out, SPAN_TYPE))


def span_text(spans: str, kinds: tuple[str, ...] | None = None):
    """kind:start:end, comma-joined; only of `kinds` if given."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else F.col(spans)
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: str, spans: str):
    """The text with every span replaced by [kind]; overlapping spans are cut where the one before
    ends.  Texts without spans stay as they are."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
    body = F.col(text)

    def step(acc, s):
        between = F.substr(body, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.when(s["end"] > acc["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise("")
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["done"], between, mark).alias("done")
        )

    def finish(acc):
        return F.concat(acc["done"], F.substr(body, acc["at"] + 1))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, finish)).otherwise(body)
