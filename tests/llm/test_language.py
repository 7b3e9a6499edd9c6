from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from gradus.llm import language, queries
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def model():
    counts = {"en": {"the": 9, "this": 4, "that": 3, "with": 3, "thing": 2}, "de": {"der": 9, "die": 8, "und": 7, "nicht": 4, "schön": 2}}
    return language.fit(counts, queries.PIECES)


def test_sum_over_all_segmentations(model):
    names = language.pieces(queries.PIECES)
    at = dict(zip(language._piece_hashes(names).tolist(), names, strict=True))
    number = {at[k]: i for i, k in enumerate(model.keys.tolist())}
    for word in ("this", "ders", "xçé", "und", "a"):
        marked = "▁" + word
        total = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(marked) - 1):
            edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(marked)]
            parts = [marked[a:b] for a, b in zip(edges, edges[1:])]
            if all(p in number or len(p) == 1 for p in parts):
                total += np.prod([model.probability[number.get(p, -1)] for p in parts], axis=0)
        assert language.word_scores([word], model)[0] == pytest.approx(np.log(total))


def test_probabilities(model):
    assert model.probability[:-1].sum(axis=0) == pytest.approx([1, 1])
    assert (np.diff(model.keys.astype(object)) > 0).all()


def test_odd_rows(spark, model):
    texts = [None, "", "12 34 !? \U0001f600", "THE THING", "die schöne", "x" * 5000, "ÉÈ", "the\x00der"]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] * 2, "doc_id long, text string, lang_pred string")
    out = language.identify(docs, model).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert len(out) == 16 and [got[i][0] for i in range(5)] == ["und", "und", "und", "en", "de"] and got[0][1] == 0 and all(0 <= s <= 1 for _, s in got.values())
    assert got[5][0] in model.languages and got[6][0] in model.languages
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"} and language.identify(docs.limit(0), model).count() == 0
    assert language.train(docs.selectExpr("doc_id", "text", "cast(null as string) lang"), queries.PIECES) is None


def test_words_beyond_the_cache(model, monkeypatch):
    monkeypatch.setattr(language, "CACHE", 2)
    few, many = language.Scorer(model), language.Scorer(model)
    raw = "the der thing und nicht".encode()
    for lo, hi in ((0, 7), (8, len(raw)), (0, len(raw))):
        part = raw[lo:hi]
        monkeypatch.setattr(language, "CACHE", 2)
        a = few.totals(part, np.array([0, len(part)]))
        monkeypatch.setattr(language, "CACHE", 1000)
        assert a == pytest.approx(many.totals(part, np.array([0, len(part)])))


def test_long_words_are_scored_whole(model, monkeypatch):
    """However the letters are cut into runs for look-up: a word's log probability is that of one forward sum in logarithms."""
    names = language.pieces(queries.PIECES)
    number = {n: i for i, n in enumerate(np.array(names, object)[np.argsort(language._piece_hashes(names))])}
    for word in ("thething" * 40, "q\u0416" * 70, "x"):
        marked, best = "\u2581" + word, [np.zeros(2)]
        for end in range(1, len(marked) + 1):
            parts = [best[start] + np.log(model.probability[number.get(marked[start:end], -1)]) for start in range(max(0, end - model.length), end) if marked[start:end] in number or end - start == 1]
            best.append(np.logaddexp.reduce(parts))
        for letters in (200_000, 50, 7):
            monkeypatch.setattr(language, "LETTERS", letters)
            assert language.word_scores([word], model)[0] == pytest.approx(best[-1], rel=1e-12)
    assert language.letters(("a" * 5000).encode()) == ["a" * 5000]


def test_query_against_brute_force(spark):
    """Every text by itself: its words by a regular expression, each by a forward sum in plain Python."""
    import functools
    import re

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.train(docs.where(~language.held_out()), queries.PIECES)
    names = language.pieces(queries.PIECES)
    order = np.argsort(language._piece_hashes(names))
    chance = {names[j]: model.probability[i].tolist() for i, j in enumerate(order.tolist())}

    @functools.cache
    def logs(word):
        marked, size = "\u2581" + word, len(model.languages)
        sums = [[1.0] * size]
        for end in range(1, len(marked) + 1):
            here = [0.0] * size
            for start in range(max(0, end - model.length), end):
                p = chance.get(marked[start:end]) or ([language.UNKNOWN] * size if end - start == 1 else None)
                if p:
                    here = [h + s * x for h, s, x in zip(here, sums[start], p, strict=True)]
            sums.append(here)
        return [math.log(x) for x in sums[-1]]

    got = {r.doc_id: r for r in queries.op6_language_id(spark, SMALL).collect()}
    for r in docs.collect():
        words = [x for w in re.findall(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", r.text) for x in [language._RUN.findall(w.lower())] if x]
        total = [sum(c) for c in zip(*[logs(x) for w in words for x in w], strict=True)]
        best = max(total)
        assert got[r.doc_id].lang_pred == model.languages[total.index(best)]
        assert got[r.doc_id].score == pytest.approx(1 / sum(math.exp((t - best) / len(words)) for t in total), rel=1e-9)


def test_held_out_accuracy(spark):
    got = queries.op6_language_id(spark, SMALL).collect()
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    own = [r for r in got if r.held_out]
    assert len(got) == len(true) and len(own) > 30 and sum(r.lang_pred == true[r.doc_id] for r in own) / len(own) >= 0.98
    assert math.isclose(sum(r.held_out for r in got) / len(got), 0.25, abs_tol=0.1)


def test_long_words_are_learned_from():
    """A word is learned from whatever its length: scripts without spaces, and beyond any table of powers."""
    thai = "ภาษาไทยเป็นภาษาที่มีระดับเสียงของคำแน่นอนหรือวรรณยุกต์" * 3
    latin = "abcdefghij" * 200
    model = language.fit({"th": {thai: 1}, "xx": {latin: 1}, "en": {"the": 5, "of": 4}}, queries.PIECES)
    flat = 1 / len(model.keys)
    for x in range(3):
        own = model.probability[:-1, x]
        assert own.sum() == pytest.approx(1) and own.max() > 50 * flat
    scores = language.word_scores(["bcdef", "ภาษาไทย", "the"], model)
    assert scores.argmax(axis=1).tolist() == [model.languages.index(x) for x in ("xx", "th", "en")]


def test_expected_pieces(model):
    """One round of counting against all segmentations, one by one."""
    names = language.pieces(queries.PIECES)
    hashes = language._piece_hashes(names)
    order = np.argsort(hashes)
    known = {names[i]: at for at, i in enumerate(order.tolist())}
    words, weight = ["a", "thé", "onder", "qqq"], np.array([[1.0, 2], [3, 0], [2, 5], [1, 1]])
    got, want = np.zeros_like(model.probability), np.zeros_like(model.probability)
    language._expect(words, weight, model.keys, model.length, model.probability, got)
    for word, w in zip(words, weight, strict=True):
        marked, ways = "▁" + word, []
        for cuts in itertools.product([0, 1], repeat=len(marked) - 1):
            edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(marked)]
            parts = [marked[a:b] for a, b in zip(edges, edges[1:])]
            if all(p in known or len(p) == 1 for p in parts):
                rows = [known.get(p, -1) for p in parts]
                ways.append((rows, np.prod(model.probability[rows], axis=0)))
        whole = sum(p for _, p in ways)
        for rows, p in ways:
            for r in rows:
                want[r] += w * p / whole
    assert got == pytest.approx(want)
