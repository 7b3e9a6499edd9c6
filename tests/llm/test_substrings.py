from __future__ import annotations

import random
from collections import Counter

import pytest

from gradus.llm import substrings


def brute(rows, width):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    count = Counter(tuple(w[k : k + width]) for _, w in texts for k in range(len(w) - width + 1))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if count[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        out.append((i if i is not None else -1, b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode(), len(w), sum(gone)))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    passages = [[r.choice("abcdefgh") for _ in range(r.randint(6, 25))] for _ in range(5)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(r.randrange(0, 5)):
            w += r.choice(passages)[r.randrange(3) :] if r.random() < 0.4 else [r.choice("abcdefghijkl") for _ in range(r.randrange(1, 20))]
        rows.append((i, " ".join(w)))
    return [*rows, (None, rows[7][1]), (7, rows[7][1]), (100, None), (101, ""), (102, "z " * 3000), (103, "a\x1cb é\tc\nd")]


@pytest.mark.parametrize("width, anchor, block", [(8, 3, 512), (8, 3, 2), (8, 2, 1), (5, 5, 512), (5, 5, 1), (12, 4, 3)])
def test_against_brute_force(spark, monkeypatch, width, anchor, block):
    monkeypatch.setattr(substrings, "BLOCK", block)
    monkeypatch.setattr(substrings, "BROADCAST_BYTES", 0 if block == 2 else 1 << 20)
    rows = corpus(width)
    got = substrings.drop_repeats(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, key int"), width=width, anchor=anchor)
    assert sorted(tuple(r) for r in got.na.fill(-1).collect()) == brute(rows, width)


def test_factors():
    import numpy as np

    a, b, c = np.array([1, 2, 3, 4, 5, 9], np.uint64), np.array([7, 2, 3, 4, 5, 6], np.uint64), np.array([8, 8, 8, 8], np.uint64)
    assert substrings.factor([a, b, c], [1, 1, 1], 3) == [[(1, 2)], [(1, 2)], [(0, 1), (1, 1)]]
    assert substrings.factor([a, b, c], [2, 1, 2], 3) == [[(0, 4)], [(1, 2)], [(0, 2)]]


def test_empty_table(spark):
    assert substrings.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        substrings.drop_repeats(spark.createDataFrame([], "doc_id long, text string"), width=3, anchor=4)
