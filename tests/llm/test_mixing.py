from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from gradus.llm import mixing


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copy_no string")


def test_odd_rows(spark):
    rows = [(1, "a" * 50, "x", "c"), (1, "a" * 50, "x", "c"), (2, None, "x", None), (None, "b" * 50, "x", None), (4, "", "empty", None), (5, "c" * 50, None, None)] + [(i, "d" * 50, "x", None) for i in range(10, 60)]
    out = mixing.mix_sources(docs(spark, rows), {"x": 3.0}).collect()
    n = {i: sorted(r.copy_no for r in out if r.doc_id == i) for i in (1, 2, None, 4, 5)}
    assert n[4] == [] and n[1] == sorted(n[1][::2] * 2) and out[0].__fields__[-1] == "copy_no"
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_sources(docs(spark, rows), {"x": 3.0}).collect()))
    assert mixing.mix_sources(docs(spark, []), {}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(docs(spark, rows), {"x": -1.0})


def test_other_columns_stay(spark):
    rows = spark.createDataFrame([(i, "text", "a", i, 2, 3, "x") for i in range(30)], "doc_id long, text string, source string, `_mine` long, COPY_NO int, `__n` int, `a.b` string")
    out = mixing.mix_sources(rows, {})
    assert out.columns == ["doc_id", "text", "source", "_mine", "__n", "a.b", "copy_no"] and all(r["_mine"] == r.doc_id and r["__n"] == 3 and r["a.b"] == "x" for r in out.collect())


def test_shares_and_poisson(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("word " * 10).alias("text"), F.when(F.col("id") % 10 == 0, "small").otherwise("big").alias("source"))
    out = mixing.mix_sources(rows, {"small": 1.0, "big": 1.0})
    count = {r[0]: r[1] for r in out.groupBy("source").count().collect()}
    assert count["small"] == pytest.approx(10_000, rel=0.05) and count["big"] == pytest.approx(10_000, rel=0.05)
    per = [r[0] for r in out.where("source = 'small'").groupBy("doc_id").count().select("count").collect()]
    rate = 5.0
    for k in (3, 5, 8):
        want = 2000 * math.exp(-rate) * rate**k / math.factorial(k)
        assert per.count(k) == pytest.approx(want, abs=5 * math.sqrt(want))
    order = [r.doc_id for r in out.select("doc_id").collect()]
    assert sum(a < b for a, b in zip(order, order[1:])) / len(order) == pytest.approx(0.5, abs=0.02)


def test_zero_weight(spark):
    rows = docs(spark, [(i, "text", "a" if i % 2 else "b", None) for i in range(40)])
    assert {r.source for r in mixing.mix_sources(rows, {"a": 0.0}).collect()} == {"b"}
