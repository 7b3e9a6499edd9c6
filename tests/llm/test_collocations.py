"""Phrases and their scores against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from gradus.llm import collocations as c


def pieces(text):
    low = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n\x0b\x0c\r]", low)]


def counts(docs, longest):
    f, n = Counter(), Counter()
    for lang, text in docs:
        for p in pieces(text):
            n["und" if lang is None else lang] += len(p)
            f.update(("und" if lang is None else lang, tuple(p[i : i + k])) for k in range(1, longest + 1) for i in range(len(p) - k + 1))
    return f, n


def best(docs, longest, least, share, top):
    f, n = counts(docs, longest)
    some = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = []
    for (lang, w), a in some.items():
        score, cut = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        inside = any(m[0] == lang and len(m[1]) > len(w) and any(m[1][i : i + len(w)] == w for i in range(len(m[1]))) and 100 * b >= share * a for m, b in some.items())
        if not inside:
            out.append((lang, " ".join(w), a, f[lang, w[:cut]], f[lang, w[cut:]], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(lang, i, *r[1:]) for i, r in enumerate(own, 1)]
    return sorted(ranked)


def made(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "né", "日本", "a\xa0b", "x", "y", "z" * 40]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\r\n", "; "]) for _ in range(rng.randrange(60)))
    return [(rng.choice(["en", "en", "fr", None, "und", ""]), rng.choice([text(), text(), "New York City is new york city. new york city", None, "", " \t", "?!"])) for _ in range(n)]


@pytest.mark.parametrize(("longest", "least", "share", "top", "shard"), [(5, 4, 100, 2000, 1 << 20), (5, 2, 100, 2000, 200), (7, 3, 60, 5, 300), (2, 3, 100, 50, 100), (3, 3, 100, 50, 500)])
def test_collocations(spark, monkeypatch, longest, least, share, top, shard):
    """Also with shards of a few words each, so that counts of many shards meet."""
    monkeypatch.setattr(c, "SHARD", shard)
    docs = made(longest)
    found = c.collocations(spark.createDataFrame([(*d, "mine") for d in docs], "lang string, text string, phrase string").repartition(5), longest=longest, least=least, share=share, top=top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {t for x, t in found.dtypes if x not in ("lang", "phrase")} == {"bigint"}
    want = best(docs, longest, least, share, top)
    assert want and sorted(map(tuple, found.collect())) == want


def test_no_rows(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert c.collocations(empty, least=1).collect() == []
    assert c.collocations(spark.createDataFrame([(None, None), ("en", ""), ("en", ",;"), ("en", "alone")], empty.schema), least=1).collect() == []
    with pytest.raises(ValueError):
        c.phrase_counts(empty, longest=1)


def test_very_long_texts(spark, monkeypatch):
    """A text of many shards is cut between pieces; a piece without end isn't."""
    monkeypatch.setattr(c, "SHARD", 1000)
    docs = [("en", "on and on " * 3000), ("en", ("one two three. " * 3000) + "w" * 50_000)]
    f, n = counts(docs, 3)
    known, total = c.phrase_counts(spark.createDataFrame(docs, "lang string, text string"), longest=3, least=1)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.n for r in known.collect()} == dict(f)
    assert {r.lang: r.total for r in total.collect()} == dict(n)


def test_large_numbers(spark, monkeypatch):
    """Scores stay exact where products pass 64 bits."""
    big = 3_000_000_019
    f = {"a b": big, "a": 2 * big + 1, "b": big + 7}
    known = spark.createDataFrame([("en", p, len(p.split()), n) for p, n in f.items()], "lang string, phrase string, k int, n bigint")
    total = spark.createDataFrame([("en", 10**13 + 1)], "lang string, total bigint")
    monkeypatch.setattr(c, "phrase_counts", lambda docs, **_: (known, total))
    (row,) = c.collocations(known).collect()
    assert row.score == 1000 * big * (10**13 + 1) // (f["a"] * f["b"]) and row.a == big


def test_intervals():
    rng = np.random.default_rng(3)
    for size in (0, 1, 2, 50, 400):
        ids = rng.integers(-1, 4, size).astype(np.int32)
        room = c.room_of(ids)
        want = Counter(tuple(ids[i : i + k]) for k in range(1, 6) for i in range(size) if room[i] >= k)
        got = {tuple(ids[p : p + k]): m for k, at, n in c.intervals(ids, room, range(1, 6)) for p, m in zip(at.tolist(), n.tolist(), strict=True)}
        assert got == want


def test_common_room():
    rng = np.random.default_rng(4)
    for width in (2, 3):
        good = rng.random(60) < 0.6
        room = c.common_room(good, width)
        for i in range(60):
            run = next((j for j in range(i, 60) if not good[j]), 60) - i
            before = [j for j in range(max(0, i - width + 1), i) if good[j]]
            assert room[i] == (run - 1 + width if run else max(0, max(before) + width - i) if before else 0)
