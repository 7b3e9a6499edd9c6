from __future__ import annotations

import random
import re

import numpy as np
import pytest

from gradus.llm import decontaminate as d

WORD = "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width):
    out = []
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for name, said in items:
            v = words(said)
            for k in range(max(1, len(v) - width + 1) if v else 0):
                p = v[k : k + width]
                for at in range(len(w) - len(p) + 1):
                    if w[at : at + len(p)] == p:
                        hit.update(range(at, at + len(p)))
                        names.add(str(name))
        out.append((i if i is not None else -1, len(w), len(hit), ",".join(sorted(names))))
    return sorted(out)


def data(seed):
    r = random.Random(seed)
    items = [(i, " ".join(r.choice("abcde") + r.choice("xy") for _ in range(r.choice([0, 2, 3, 6, 9])))) for i in range(12)] + [(12, None), (None, "ax bx cx")]
    docs = []
    for i in range(50):
        w = [r.choice("abcdefg") + r.choice("xyz") for _ in range(r.randrange(0, 40))]
        if r.random() < 0.5:
            at = r.randrange(len(w) + 1)
            w[at:at] = words(r.choice(items[:12])[1])
        docs.append((i, r.choice([" ", "-", ". "]).join(w).upper() if r.random() < 0.3 else " ".join(w)))
    return [*docs, docs[3], (None, docs[4][1]), (60, None), (61, ""), (62, "é ß"), (63, "q " * 50_000)], items


@pytest.mark.parametrize("shard, blocks", [(4 << 20, 16 << 20), (300, 16 << 20), (4 << 20, 60)])
def test_against_brute_force(spark, monkeypatch, shard, blocks):
    monkeypatch.setattr(d, "SHARD", shard)
    monkeypatch.setattr(d, "PHRASE_BYTES", blocks)
    docs, items = data(5)
    given = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, _hits int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    marked = d.mark(given, bench, width=5)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r["_hits"]["words"], sum(s["end"] - s["start"] for s in r["_hits"]["spans"]), ",".join(r["_hits"]["items"])) for r in marked.collect())
    assert got == brute(docs, [x for x in items if x[0] is not None], 5)


def test_removal(spark):
    docs = spark.createDataFrame([(1, "Keep this, one two-THREE four. And this", 39, "s"), (2, "one two three four", 18, None), (3, "clean  text ", 12, "s"), (4, None, None, "s")], "doc_id long, text string, n_chars long, source string")
    bench = spark.createDataFrame([("i", "One two three four")], "item_id string, text string")
    out = {r.doc_id: r for r in d.remove(d.mark(docs, bench)).collect()}
    assert out[1].text == "Keep this, . And this" and out[1].n_chars == 21 and out[3].text == "clean  text " and out[4].text is None and 2 not in out
    assert d.mark(docs.limit(0), bench).count() == 0 and d.mark(docs, bench.limit(0)).where("size(_hits.spans) > 0").count() == 0


@pytest.mark.parametrize("blocks", [16 << 20, 60])
def test_one_pass_cuts_like_two(spark, monkeypatch, blocks):
    monkeypatch.setattr(d, "PHRASE_BYTES", blocks)
    docs, items = data(9)
    given = spark.createDataFrame([(i, t, len(t or ""), "k") for i, t in docs], "doc_id long, text string, n_chars int, `_hits` string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, two = d.cut(given, bench, width=5), d.remove(d.mark(given, bench, width=5))
    assert one.columns == two.columns == ["doc_id", "text", "n_chars"]
    rows = sorted(map(str, one.collect()))
    assert rows == sorted(map(str, two.collect())) and 0 < len(rows) < len(docs) and d.cut(given.limit(0), bench).count() == 0


def test_suffix_array_and_index():
    r = random.Random(1)
    for n in (1, 2, 7, 60, 300):
        text = np.array([0, *[r.choice([0, 1, 1, 2, 3]) for _ in range(n)], 0])
        order = d.suffix_array(text)
        zeros = np.cumsum(text == 0) - 1
        key = lambda i: [int(zeros[j]) - len(text) if text[j] == 0 else int(text[j]) for j in range(i, next(j for j in range(i, len(text)) if text[j] == 0) + 1)]  # noqa: B023, E731
        assert order.tolist() == sorted(range(len(text)), key=key)
        index = d.Index(text, 3, sample=4)
        for pattern in ([1], [1, 1], [2, 1, 3], [3, 3]):
            lo, hi = index.search(np.array([[0] * (3 - len(pattern)) + pattern]), np.array([len(pattern)]))
            found = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
            assert found == [i for i in range(len(text)) if text[i : i + len(pattern)].tolist() == pattern]
