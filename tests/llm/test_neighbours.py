from __future__ import annotations

import numpy as np
import pytest

from gradus.llm import neighbours, queries
from tests.conftest import SMALL


def exact(ids, x, query, k):
    score = (x * x[query]).sum(axis=1)
    order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[query]]
    return [(int(ids[i]), float(score[i])) for i in order[:k]]


def table(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.1"])
def test_recall_of_the_query(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in queries.op8_one_bit_neighbours(spark, folder).collect()}
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        best = exact(ids, x, q, 20)
        own = [got[ids[q], r] for r in range(1, 21)]
        hits += len({v for v, _ in own} & {v for v, _ in best})
        total += 20
        assert all(s == pytest.approx(float((x[ids == v][0] * x[q]).sum()), rel=1e-14) for v, s in own)
        assert own == sorted(own, key=lambda p: (-p[1], p[0]))
    assert hits / total >= 0.9 and len(got) == total


def test_few_are_reranked(spark):
    """At sf0.1 the codes leave a twentieth of all pairs at most; 1 % is what an exact search would return."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x, _ = neighbours.different(neighbours.usable(v, "vec_id", "embedding"), 21)
    asked, _ = neighbours.different(neighbours.usable(v.where("vec_id % 20 = 0"), "vec_id", "embedding"), None)
    share = neighbours.candidates(x, asked, most=21).count() / (x.count() * asked.count())
    assert 0.01 < share < 0.05


def clustered(rng, n):
    centres = 6 * rng.standard_normal((8, 32))
    return (centres[rng.integers(0, 8, n)] + 0.2 * rng.standard_normal((n, 32))).astype("float32")


def test_bounds_rule_cells_out(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 50)
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    monkeypatch.setattr(neighbours, "QUERIES", 4)
    x = clustered(np.random.default_rng(4), 1600)
    v = table(spark, x)
    keys, _ = neighbours.different(neighbours.usable(v, "vec_id", "embedding"), 6)
    asked, _ = neighbours.different(neighbours.usable(v.where("vec_id % 40 = 0"), "vec_id", "embedding"), None)
    samples = neighbours.take_samples(keys, 5)
    index, radius = neighbours.build(keys, samples, 5)
    groups = neighbours.ask(asked, samples, radius, 6, 5)
    assert index.selectExpr("size", "cell").distinct().count() == len(samples[32].centres) == 32 and index.count() > 40
    allowed = sum(len(r.cells) * len(r["keys"]) // 8 for r in groups.collect())
    assert allowed < 40 * 32 / 2
    got = {(r.query_id, r.rank): r.vec_id for r in neighbours.nearest(v, v.where("vec_id % 40 = 0"), k=5).collect()}
    want = {(q, r + 1): i for q in range(0, 1600, 40) for r, (i, _) in enumerate(exact(np.arange(1600), x.astype(float), q, 5))}
    assert sum(got[p] == want[p] for p in want) / len(want) >= 0.9 and got.keys() == want.keys()


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [2.0, -0.0], 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [inf, 1.0], 1), (8, [nan, 1.0], 1), (9, [1.0], 1), (10, [], 1), (None, [5.0, 5.0], 1), (2, [2.0, 0.0], 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = [tuple(r) for r in neighbours.nearest(v, v, k=5).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2, 2.0), (1, 2, 3, 2.0), (2, 1, 3, 4.0), (2, 2, 1, 2.0), (3, 1, 2, 4.0), (3, 2, 1, 2.0)]
    assert neighbours.nearest(v.limit(0), v, k=5).count() == 0 and neighbours.nearest(v, v.limit(0), k=5).count() == 0


def test_lengths_and_ids_that_repeat(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [3.0, 3.0]), (2, [1.0, 1.0]), (3, [0.5, 0.5]), (4, [2.0]), (5, [3.0]), (6, [1.0, 2.0, 3.0])]
    v = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in neighbours.nearest(v, v, k=2).collect()}
    assert got == {(1, 1): (2, 6.0), (1, 2): (3, 3.0), (2, 1): (1, 6.0), (2, 2): (1, 1.0), (3, 1): (1, 3.0), (3, 2): (2, 1.0), (4, 1): (5, 6.0), (5, 1): (4, 6.0)}


def test_many_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    x = np.random.default_rng(2).standard_normal((300, 16)).astype("float32")
    x[:200] = x[0]
    v = table(spark, x)
    got = {(r.query_id, r.rank): r.vec_id for r in neighbours.nearest(v, v.where("vec_id in (7, 190)"), k=20).collect()}
    assert got == {(q, r + 1): i for q in (7, 190) for r, (i, _) in enumerate(exact(np.arange(300), x.astype(float), q, 20))}
    assert neighbours.different(neighbours.usable(v, "vec_id", "embedding"), 21)[1].count() == 121


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for size in (20, 64, 700):
        x, q = rng.standard_normal((500, size)) + 0.3, rng.standard_normal((20, size))
        turn, centre = neighbours.frame(size, 5), x.mean(axis=0)
        assert turn @ turn.T == pytest.approx(np.eye(size)) and turn.shape[1] % 64 == 0
        estimate, error = neighbours.bounds(*neighbours.planes_of(q, turn), *neighbours.encode(x - centre, turn), q @ centre)
        off = np.abs(estimate - q @ x.T)
        assert (off <= error).mean() > 0.92 and (estimate - q @ x.T).mean() == pytest.approx(0, abs=0.05 * np.sqrt(size))


def cone(rng, n, size):
    """Vectors of length 1 that have most of their length in common."""
    x = 5 * rng.standard_normal((1, size)) / np.sqrt(size) + 0.05 * rng.standard_normal((n, size)) / np.sqrt(size)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("float32")


@pytest.mark.parametrize("kind", ["cone", "wide", "ties"])
def test_recall_on_other_rows(spark, kind):
    """Rows that codes tell little about: estimates aren't held against estimates, and every query gets its number of vectors."""
    rng, n = np.random.default_rng(7), 1000
    x = {"cone": lambda: cone(rng, n, 64), "wide": lambda: rng.standard_normal((n, 768)), "ties": lambda: rng.integers(0, 2, (n, 16))}[kind]().astype("float32")
    v = table(spark, x)
    got = {(r.query_id, r.rank): r.vec_id for r in neighbours.nearest(v, v.where("vec_id % 20 = 0"), k=20).collect()}
    assert len(got) == n // 20 * 20
    hits = sum(len({got[q, r] for r in range(1, 21)} & {i for i, _ in exact(np.arange(n), x.astype(float), q, 20)}) for q in range(0, n, 20))
    assert hits / len(got) >= 0.99


def test_codes_leave_few_products(spark):
    """At sf0.1 one of eight pairs at most is multiplied in full; the codes rule out the others."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x, _ = neighbours.different(neighbours.usable(v, "vec_id", "embedding"), 21)
    asked, _ = neighbours.different(neighbours.usable(v.where("vec_id % 20 = 0"), "vec_id", "embedding"), None)
    samples = neighbours.take_samples(x, 5)
    index, radius = neighbours.build(x, samples, 5)
    blocks, scored = index.collect(), 0
    for group in neighbours.ask(asked, samples, radius, 21, 5).collect():
        search, centred = neighbours.Search(group.asDict(), 21), {c.cell: c.centred for c in group.cells}
        for block in blocks:
            search.visit({**block.asDict(), "centred": centred[block.cell]})
        scored += search.scored
    share = scored / (x.count() * asked.count())
    assert 0.01 < share < 0.125, share
