"""Chunks, collections and digests: what a broken run leaves is never seen."""

from __future__ import annotations

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gradus.operators import validate
from gradus.operators.validate import InvalidData
from gradus.sources import chunks, tables


def rows(spark, *numbers):
    return spark.createDataFrame([(n, n % 2) for n in numbers], "n int, kind int")


def values(spark, path):
    lines = chunks.read_text(spark, path, "kind INT")
    return sorted((r.chunk, r.kind, r.value) for r in lines.collect())


def test_a_chunk_is_added_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert chunks.read_text(spark, path) is None
    assert chunks.append(rows(spark, 1, 2), path, "a", "kind") and not chunks.append(rows(spark, 9), path, "a", "kind")
    assert chunks.append(rows(spark, 3), path, "b", "kind") and chunks.append(rows(spark).limit(0), path, "empty", "kind")
    assert values(spark, path) == [("a", 0, '{"n":2}'), ("a", 1, '{"n":1}'), ("b", 1, '{"n":3}')]
    assert list(chunks.log(path)) == ["a", "b", "empty"]


def test_killed_after_the_write(spark, tmp_path, monkeypatch):
    """A chunk that was written, but not yet published, isn't there; the next try adds it once."""
    path = str(tmp_path / "t")
    chunks.append(rows(spark, 1), path, "a", "kind")

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(tables, "rename_new", killed)
        with pytest.raises(KeyboardInterrupt):
            chunks.append(rows(spark, 2), path, "b", "kind")
    assert [r[0] for r in values(spark, path)] == ["a"]
    assert chunks.append(rows(spark, 2), path, "b", "kind")
    assert [r[0] for r in values(spark, path)] == ["a", "b"]


def test_failed_while_writing(spark, tmp_path):
    path = str(tmp_path / "t")
    bad = rows(spark, 1, 2).withColumn("n", F.when(F.col("n") == 2, F.raise_error("lost").cast("int")).otherwise(F.col("n")))
    with pytest.raises(PySparkException):
        chunks.append(bad, path, "a", "kind")
    assert chunks.read_text(spark, path) is None and chunks.append(rows(spark, 5), path, "a", "kind")


def test_two_who_publish_one_chunk(spark, tmp_path, monkeypatch):
    """Both have written before either publishes: the first rename counts."""
    path, seen = str(tmp_path / "t"), []
    publish = tables.rename_new

    def meanwhile(source, target):
        if not seen:
            seen.append(1)
            assert chunks.append(rows(spark, 7), path, "a", "kind")
        return publish(source, target)

    monkeypatch.setattr(tables, "rename_new", meanwhile)
    assert not chunks.append(rows(spark, 8), path, "a", "kind")
    assert values(spark, path) == [("a", 1, '{"n":7}')] and not [n for n in os.listdir(path) if n.endswith(".json")]


def collection(spark, text="a"):
    return {"queries": spark.createDataFrame([("1", text)], "query_id string, text string"), "passages": spark.createDataFrame([("p", "t")], "passage_id string, text string"), "qrels": spark.createDataFrame([("1", "p", 1)], "query_id string, passage_id string, relevance int")}


@pytest.mark.parametrize("revision", [None, "r1"])
def test_half_written_tables(spark, tmp_path, revision):
    """A folder that a broken write left is no table: the next write makes it whole."""
    folder = str(tmp_path / "c")
    for left in (f"{folder}/queries", f"{folder}/revisions/r1/queries", f"{folder}/data/x/queries/_temporary"):
        os.makedirs(left)
    with pytest.raises(InvalidData, match="has no queries, passages, qrels"):
        tables.read_collection(spark, folder, revision)
    bad = {**collection(spark), "qrels": collection(spark)["qrels"].withColumn("relevance", F.raise_error("lost").cast("int"))}
    with pytest.raises(PySparkException):
        tables.write_collection(bad, folder, revision)
    with pytest.raises(InvalidData, match="has no"):
        tables.read_collection(spark, folder, revision)
    for _ in range(2):
        tables.write_collection(collection(spark), folder, revision)
    assert tables.read_collection(spark, folder, revision)["queries"].first().text == "a"
    with pytest.raises(InvalidData):
        tables.write_collection(collection(spark, "b"), folder, revision)
    assert tables.read_collection(spark, folder, revision)["queries"].first().text == "a"


def test_missing_tables_are_added(spark, tmp_path):
    """Also to whole tables that were written before there was a manifest."""
    folder, given = str(tmp_path / "c"), collection(spark)
    given["queries"].write.parquet(f"{folder}/queries")
    tables.write_collection({"passages": given["passages"]}, folder)
    with pytest.raises(InvalidData, match="has no qrels"):
        tables.read_collection(spark, folder)
    tables.write_collection(given, folder)
    assert {n: t.count() for n, t in tables.read_collection(spark, folder).items()} == {"queries": 1, "passages": 1, "qrels": 1}


def test_digests(spark):
    made = lambda data: spark.createDataFrame(data, "a string, b string, c array<string>, d struct<x: int, y: int>, e map<string, int>")
    base = [("x", None, ["a", None], (1, None), {"k": 1}), (None, "x", [None, "a"], (None, 1), {}), ("x", None, ["a", None], (1, None), {"k": 1}), ("", "", [], None, None)]
    same = lambda p, q: tuple(validate.same_rows(made(p), made(q)).first())
    assert same(base, base[::-1]) == (True, 4, 4) and same([], []) == (True, 0, 0) and not same(base, [])[0]
    assert not same(base, [base[0], base[1], base[1], base[3]])[0]  # as many rows, other repeats
    for other in ((None, "x", ["a", None], (1, None), {"k": 1}), ("x", None, [None, "a"], (1, None), {"k": 1}), ("x", None, ["a", None], (None, 1), {"k": 1}), ("x", None, ["a", None], (1, None), {"k": 2}), ("x", "", ["a", None], (1, None), {"k": 1})):
        assert not same(base, [other, *base[1:]])[0]


def test_equal_though_digests_differ(spark):
    """0.0 and -0.0 are one value: the full comparison has the last word."""
    zero = spark.createDataFrame([(0.0,), (1.0,)], "v double")
    validate.check_equal(zero, spark.createDataFrame([(1.0,), (-0.0,)], "v double"))
    with pytest.raises(InvalidData, match="first"):
        validate.check_equal(zero, zero.where("v > 0"))
