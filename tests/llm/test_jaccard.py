from __future__ import annotations

import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from gradus.llm import jaccard
from gradus.llm.components import components

SCHEMA = "doc_id long, text string, sig int, key string"


def words(text):
    return re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, width, t):
    sets, tree = {}, {}
    for i, text in rows:
        w = words(text)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
        tree[i] = i
    find = lambda x: x if tree[x] == x else find(tree[x])
    ids = list(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                tree[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, passage = [], " ".join(r.choices(vocabulary, k=40))
    for base in range(12):
        own = r.choices(vocabulary, k=r.choice([5, 8, 20, 60, 150, 400]))
        for _ in range(r.choice([1, 2, 6])):
            copy = list(own)
            for _ in range(r.randrange(0, 1 + len(own) // 40)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append(" ".join(copy) + (" " + passage if r.random() < 0.3 else ""))
    rows += ["", " \t\n", "one", "ONE", "one two", "a b c", "a b c d", "a b c d e", *[" ".join(r.choices(vocabulary, k=3000))] * 2]
    r.shuffle(rows)
    return [*enumerate(rows), (1000, None)]


@pytest.mark.parametrize("width, t", [(4, "0.85"), (5, "0.8"), (2, "0.5")])
def test_components(spark, width, t):
    rows = corpus()
    got = jaccard.jaccard_components(spark.createDataFrame([(i, x, 1, "k") for i, x in rows], SCHEMA), width=width, similarity=t)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows, width, Fraction(t))


@pytest.mark.parametrize("seed, width, t", [(4, 4, "0.85"), (5, 3, "0.6")])
def test_small_panels_and_chunks(spark, monkeypatch, seed, width, t):
    monkeypatch.setattr(jaccard, "PANEL", 2)
    monkeypatch.setattr(jaccard, "GROUP", 3)
    monkeypatch.setattr(jaccard, "PARTNERS", 1)
    monkeypatch.setattr(jaccard, "CHUNK_ENTRIES", 500)
    rows = corpus(seed)
    got = jaccard.jaccard_components(spark.createDataFrame([(i, x, 1, "k") for i, x in rows], SCHEMA), width=width, similarity=t)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows, width, Fraction(t))


def test_links_that_no_least_row_sees(spark):
    """A long text holds all rare shingles of a group of near copies and comes first in every column, but links with none."""
    r = random.Random(8)
    base = [f"v{i}" for i in range(60)]
    group = []
    for _ in range(12):
        own = list(base)
        own[r.randrange(60)] = f"x{r.randrange(10**6)}"
        group.append(" ".join(own))
    rows = list(enumerate([*group, " ".join([*group, *base])]))
    got = jaccard.jaccard_components(spark.createDataFrame([(i, x, 1, "k") for i, x in rows], SCHEMA), width=3, similarity="0.8")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows, 3, Fraction("0.8"))


@pytest.mark.parametrize("group, panel", [(64, 512), (3, 2), (10**6, 3)])
def test_tiles_join_what_stars_leave_apart(spark, monkeypatch, group, panel):
    """Rows of a column that meet neither their head nor each other before: tiles must find them, failed pairs and all."""
    monkeypatch.setattr(jaccard, "GROUP", group)
    monkeypatch.setattr(jaccard, "PANEL", panel)
    monkeypatch.setattr(jaccard, "PARTNERS", 2 if panel == 3 else 32)
    rng, t = np.random.default_rng(6), Fraction("0.7")
    core = [np.unique(rng.integers(1, 1 << 62, 90, dtype=np.uint64)) for _ in range(5)]
    sets = [np.unique(np.concatenate([c[rng.random(len(c)) < 0.93], rng.integers(1, 1 << 62, 3, dtype=np.uint64)])) for c in core for _ in range(9)]
    alone = np.unique(rng.integers(1, 1 << 62, 90, dtype=np.uint64))
    every = [alone, *sets]
    own = []
    for v in every:
        off = np.array([0, len(v)])
        own.append((int(jaccard.signatures(v, off)[0]), len(v), v.view(np.int64).tolist(), jaccard.wide_parities(v, off)[0]))
    head = min(x[0] for x in own) - 1  # a row of no set that is least in the only column
    frame = spark.createDataFrame([*own, (head, 90, alone.view(np.int64).tolist(), own[0][3])], "sig long, n long, set array<long>, wide binary")
    live = frame.selectExpr("1L col", "sig", f"{head}L head")
    found = jaccard._links(live, frame, t)
    got = {r.node: r.component for r in found.collect()}
    tree = {x[0]: x[0] for x in own} | {head: head}
    find = lambda x: x if tree[x] == x else find(tree[x])
    full = [*[(x[0], set(x[2])) for x in own], (head, set(own[0][2]))]
    for i, (a, x) in enumerate(full):
        for b, y in full[:i]:
            if len(x & y) >= t * len(x | y):
                u, v = find(a), find(b)
                tree[max(u, v)] = min(u, v)
    assert {s: got.get(s, s) for s in tree} == {s: find(s) for s in tree}


def test_odd_rows(spark):
    text = "the same text in every one of these rows"
    docs = spark.createDataFrame([(5, text, 0, ""), (5, text, 0, ""), (None, text, 0, ""), (7, text, 0, ""), (9, None, 0, ""), (None, None, 0, "")], SCHEMA)
    got = sorted(tuple(r) for r in jaccard.jaccard_components(docs).na.fill(-1).collect())
    assert got == [(-1, 0, -1), (-1, 5, 5), (5, 5, 5), (5, 5, 5), (7, 5, 5), (9, 0, 9)]
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0
    kept = jaccard.keep_first(docs)
    assert sorted((r.doc_id or -1, r.text is None) for r in kept.collect()) == [(-1, False), (-1, True), (5, False), (9, True)] and kept.columns == docs.columns
    with pytest.raises(ValueError):
        jaccard.jaccard_components(docs, similarity="0")


def test_similar_sets_share_one_of_their_rarest_columns():
    """Every two sets at the bound do, whatever their sizes and whatever the order."""
    rng = np.random.default_rng(0)
    for t in ("0.85", "0.8", "0.6", "1"):
        q = Fraction(t)
        for n in [*range(1, 60), 100, 333]:
            for extra in (0, 1, 2):
                shared, room = list(range(n)), int((n - q * n) / q)
                left = room * extra // 2
                x, y = [*shared, *range(1000, 1000 + left)], [*shared, *range(2000, 2000 + room - left)]
                order = rng.permutation(4000)
                first = [set(sorted(v, key=order.__getitem__)[: int(jaccard.prefix(np.array([len(v)]), q)[0])]) for v in (x, y)]
                assert first[0] & first[1], (t, n, left, room)


def test_squeezed_values():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000):
        for top in (1 << 20, 1 << 63):
            v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
            assert (jaccard.unsqueeze(jaccard.squeeze(v)) == v).all()
    assert jaccard.unsqueeze(jaccard.squeeze(np.array([5, 5, 5], np.uint64))).tolist() == [5, 5, 5]


def test_parities_bound_the_difference():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:300], rng.integers(0, 1 << 63, 90, dtype=np.uint64)]))
    p, q = (np.frombuffer(jaccard.wide_parities(v, np.array([0, len(v)]))[0], np.uint8)[None] for v in (a, b))
    assert p.shape[1] > q.shape[1]
    assert 0 < np.bitwise_count(jaccard.folded(p, q.shape[1]) ^ q).sum() <= len(set(a.tolist()) ^ set(b.tolist()))


def test_set_rows_of_short_texts():
    (_, values, offsets), = jaccard.sets(pa.array(["", "a", "a b c d", None]), 4)
    assert offsets.tolist() == [0, 0, 1, 2, 2]


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (200, 100)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 100}
