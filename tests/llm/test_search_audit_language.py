"""Ranked search, filter audit and language identification against plain versions, with edge cases."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from annolytics.llm import filter_audit, language, lexical_search

SCHEMA = "doc_id bigint, text string, lang string, source string, score string, rank int, n int, terms int, part int, lang_pred string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(65, 91)}
VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def frame(spark, rows):
    """Rows of (doc_id, text, lang); the other columns carry names used inside."""
    return spark.createDataFrame([(*r, "s", "x", 1, 2, 3, 4, "y") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- search ---------------------------------------------------------------------------------------


def plain_search(rows, items, size=10):
    terms = [(i, Counter(TERM.findall((t or "").translate(UPPER)))) for i, t, *_ in rows]
    terms = [(i, c) for i, c in terms if c]
    count, total = len(terms), sum(c.total() for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(TERM.findall((text or "").translate(UPPER)))
    found = []
    for item, words in asked.items():
        scores = []
        for i, c in terms:
            m = 10 + 90 * c.total() * count // total
            score = sum(
                math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in words & c.keys()
            )
            if score > 0:
                scores.append((-score, i is None, i or 0))
        for rank, (score, null, i) in enumerate(sorted(scores)[:size], start=1):
            found.append((item, rank, None if null else i, -score))
    return found


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    texts = [" ".join(rng.choices(words, weights, k=rng.randrange(1, 80))) for _ in range(n)]
    return [(i, t, "en") for i, t in enumerate(texts)]


def test_search_equals_scoring_everything(spark):
    rows = corpus(700)
    rows += [(i + 2_000, t, l) for i, t, l in rows[:60]]  # ties
    rows += [(5, rows[5][1], "en"), (None, rows[6][1], None), (3_000, None, "en"), (3_001, "", "en"), (3_002, "-- !", "en")]
    rows += [(3_003, "É-é w1 Ünï W2 w2\x00w3 w4", "fr"), (3_004, " ".join(f"w{i % 400}" for i in range(30_000)), "en")]
    items = [(i, t) for i, t, _ in rows[100:130]] + [(5, None), (6, ""), (7, "w399 é W2 w2"), (7, "w1"), (None, "w7")]
    items += [(8, "unheard of")]
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id bigint, text string, rank int, score int")
    index = lexical_search.build_index(frame(spark, rows).repartition(3, "text"))
    found = lexical_search.search(index, asked)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, plain_search(rows, items)))


def test_search_in_several_batches_and_slices(spark, monkeypatch):
    rows, items = corpus(300, 2), [(i, t) for i, t, _ in corpus(25, 3)]
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(lexical_search, "BATCH_TERMS", 120)
    monkeypatch.setattr(lexical_search, "SLICE_DOCUMENTS", 64)
    monkeypatch.setattr(lexical_search, "KEPT_MAXIMA", 500)
    found = lexical_search.search(lexical_search.build_index(frame(spark, rows)), asked)
    assert sorted(map(tuple, found.collect())) == sorted(plain_search(rows, items))


def test_search_of_nothing(spark, none):
    asked = spark.createDataFrame([(1, "w1")], "item_id bigint, text string")
    assert lexical_search.search(lexical_search.build_index(none), asked).count() == 0
    assert lexical_search.search(lexical_search.build_index(frame(spark, [(1, "!", "en")])), asked).count() == 0
    index = lexical_search.build_index(frame(spark, corpus(5)))
    assert lexical_search.search(index, asked.limit(0)).count() == 0


def a_slice(vectors, width):
    rows = np.repeat(np.arange(len(vectors)), [len(v) for v in vectors])
    terms = np.array([t for v in vectors for t in sorted(v)])
    impacts = np.array([v[t] for v in vectors for t in sorted(v)])
    ids = np.arange(len(vectors))
    return lexical_search.Slice(ids, np.zeros(len(ids), bool), rows, terms, impacts, width)


def test_blocks_bound_their_documents_and_skip():
    rng = random.Random(4)
    # two kinds of documents, of which one scores far more for the item
    vectors = [
        {0: 5, **{t: rng.randrange(50, 60) if i % 2 else 1 for t in rng.sample(range(1, 12), 8)}} for i in range(400)
    ]
    part, item = a_slice(vectors, 12), np.arange(12)
    wanted = np.ones(12, np.int64)
    blocks = part.blocks(0)
    assert np.bincount(blocks.place).max() <= lexical_search.BLOCK
    assert sorted(blocks.documents.tolist()) == list(range(400))
    bounds = blocks.bounds(wanted)
    scores = np.array([sum(v.values()) for v in vectors])
    assert (scores[blocks.documents] <= bounds[blocks.place]).all()
    for i, block in enumerate(np.unique(blocks.place)):
        inside = blocks.documents[blocks.place == block]
        assert bounds[i] == sum(max(vectors[d].get(t, 0) for d in inside) for t in range(12))
    best = lexical_search.Best(10)
    part.search(item, best)
    assert best.ids.tolist() == sorted(range(400), key=lambda d: (-scores[d], d))[:10]
    assert part.skipped > 0 and part.scored < 400


# --- audit ----------------------------------------------------------------------------------------


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, t, lang in rows:
        t = t or ""
        words = WORD.findall(t)
        fails.append((
            lang or "", i,
            {
                "A": len(words) < 100,
                "B": 100 * len(set(words)) < 80 * len(words),
                "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
                "D": bool(re.search("[#$%&*|]", t)),
                "E": i is not None and i > least[t],
            },
        ))
    found = []
    for part in {p for p, *_ in fails}:
        mine = [(i, f) for p, i, f in fails if p == part]
        removed_by, out = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, start=1):
                here = [(i, f) for i, f in left if f[letter]]
                left = [(i, f) for i, f in left if not f[letter]]
                removed_by[letter] += len(here)
                out.append((
                    part, "".join(order), step, len(left), len(here),
                    sum(f[letter] for _, f in mine) - len(here),
                    sum(f[letter] and sum(f.values()) == 1 for _, f in mine),
                    sum(i in good for i, _ in here), sum(i in toxic for i, _ in here), letter,
                ))
        found += [(*r[:-1], removed_by[r[-1]]) for r in out]
    return found


def test_audit_equals_applying_every_order(spark, none):
    rng = random.Random(5)

    def text():
        words = [rng.choice(["ab", "CD", "Émile", "x|y"]) + str(rng.randrange(rng.choice([10, 500]))) for _ in range(rng.choice([3, 99, 100, 130]))]
        return rng.choice([" ", "\t", "\x0b\n", "  "]).join(words)

    texts = [text() for _ in range(60)] + ["", None, "A", "é" * 9 + "A", "é" * 8 + "A", "a\x1cb", "#", " \n "]
    rows = [(i, t, rng.choice(["en", "fr", None, ""])) for i, t in enumerate(texts * 2)]
    rows += [(3, texts[3], "fr"), (3, texts[3], "fr"), (None, texts[4], "en"), (None, None, None), (999, "W " * 50_000, "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(40)] + [(3, 1, 0), (None, 1, 1), (7_777, 1, 1)]
    marks = spark.createDataFrame([(*x, 1) for x in labels], "doc_id bigint, quality int, toxic int, mask int")
    found = filter_audit.audit(frame(spark, rows).repartition(4, "text"), marks)
    assert sorted(map(tuple, found.collect())) == sorted(plain_audit(rows, labels))
    assert filter_audit.audit(none, marks).count() == 0
    assert filter_audit.audit(frame(spark, rows[:2]), marks.limit(0)).count() % 600 == 0


def test_intervals_cover_each_order_once():
    orders = filter_audit.orders()
    assert orders == sorted(orders)
    for mask in range(32):
        at = Counter()
        for step, start, stop in filter_audit.intervals(mask):
            for rank in range(start, stop):
                letters = [filter_audit.FILTERS.index(c) for c in orders[rank]]
                assert mask >> letters[step - 1] & 1 and not any(mask >> f & 1 for f in letters[: step - 1])
                at[rank] += 1
        assert at == ({r: 1 for r in range(120)} if mask else {})


# --- language -------------------------------------------------------------------------------------


def segmentations(word, pieces):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in pieces:
            yield from ([pieces[word[:k]], *rest] for rest in segmentations(word[k:], pieces))
        elif k == 1:
            yield from ([language.UNKNOWN, *rest] for rest in segmentations(word[1:], pieces))


def test_forward_sums_all_segmentations_and_expectations_follow():
    rng = np.random.default_rng(6)
    pieces = {p: i + 1 for i, p in enumerate(["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab", "bab"])}
    segmenter = language.Segmenter(pieces)
    table = np.vstack([rng.random((segmenter.size, 3)), np.zeros((1, 3))])
    for length in (1, 2, 5, 8):
        words = ["".join(rng.choice(list("abx"), length)) for _ in range(7)]
        ways = [list(segmentations("▁" + w, pieces)) for w in words]
        sums = np.array([[sum(np.prod(table[s, k]) for s in way) for k in range(3)] for way in ways])
        assert np.allclose(segmenter.log_probabilities(words, table), np.log(sums))
        expected, weights = np.zeros(segmenter.size), rng.random(7)
        for way, w, total in zip(ways, weights, sums[:, 1], strict=True):
            for s in way:
                for p in s:
                    expected[p] += w * np.prod(table[s, 1]) / total
        assert np.allclose(segmenter.expected(words, weights, table[:, 1]), expected)


def test_long_words_do_not_underflow():
    segmenter = language.Segmenter({"▁": 1, "a": 2, "aa": 3})
    table = np.array([[1e-8], [0.1], [1e-6], [1e-9], [0.0]])
    (got,) = segmenter.log_probabilities(["a" * 3_000], table)[0]
    ways, scale = [1.0, 0.1], 0.0  # two newest forward sums
    for _ in range(3_000):
        # the mark cannot end a longer piece, so "aa" needs two letters
        new = ways[1] * 1e-6 + (ways[0] * 1e-9 if _ else 0)
        ways, scale = [ways[1] / new, 1.0], scale + math.log(new)
    assert math.isclose(got, scale, rel_tol=1e-9)


def sentences(lang, n, seed):
    rng = random.Random(seed)
    syllables = {"aa": ["la", "no", "ri", "ve"], "bb": ["sch", "ung", "ein", "ter"], "cc": ["ou", "eau", "ç", "ne"]}[lang]
    return [" ".join("".join(rng.choices(syllables, k=3)) for _ in range(12)) for _ in range(n)]


def test_languages_are_told_apart(spark, none):
    rows = [(i, t, lang) for k, lang in enumerate(["aa", "bb", "cc"]) for i, t in enumerate(sentences(lang, 60, k), k * 100)]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 !?", "cc"), (903, "LANO RIVE!", None), (None, "einung", "bb")]
    rows += [(904, "漢字 ungein", "bb"), (904, "漢字 ungein", "bb"), (905, "la" * 20_000, None)]
    docs = frame(spark, rows).repartition(3, "text")
    model = language.learn(docs, VOCABULARY)
    assert model.languages == ["aa", "bb", "cc"]
    assert np.allclose(model.table.sum(axis=0), 1)
    found = language.with_languages(docs, model)
    assert found.columns == [*docs.columns, "lang_pred_", "score_"] and found.count() == len(rows)
    for r in found.collect():
        assert 0 <= r.score_ <= 1
        if r.doc_id in (900, 901, 902):
            assert (r.lang_pred_, r.score_) == ("und", 0.0)
        elif r.lang:
            assert r.lang_pred_ == r.lang
        else:
            assert r.lang_pred_ == "aa"
    untaught = language.learn(none, VOCABULARY)
    assert {(r.lang_pred_, r.score_) for r in language.with_languages(docs, untaught).collect()} == {("und", 0.0)}
    assert language.with_languages(none, model).count() == 0


def test_held_out_rows_and_a_repeated_id_teach_nothing_more(spark):
    from annolytics.llm.common import id_crc

    rows = [(i, t, "aa") for i, t in enumerate(sentences("aa", 40, 1))]
    docs = frame(spark, rows)
    kept = docs.filter(id_crc() % 4 != 2)
    assert kept.count() < docs.count()
    one, two = language.learn(docs, VOCABULARY), language.learn(kept.unionAll(kept), VOCABULARY)
    assert np.array_equal(one.table, two.table)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = language.with_languages(docs, language.learn(docs, VOCABULARY))
    right, all_ = found.filter("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2").selectExpr(
        "count_if(lang = lang_pred)", "count(*)"
    ).first()
    assert right >= 0.97 * all_ > 0
