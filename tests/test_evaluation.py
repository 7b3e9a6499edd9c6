"""Hand-computed results and properties of the metrics."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from gradus.operators import agreement, correlation, ranking, usage
from gradus.operators.agreement import NO_VARIATION
from gradus.operators.correlation import CONSTANT

P = "msmarco_passage_00_"


def scores(spark, runs, judged):
    r = spark.createDataFrame([(run, q, P + str(d), float(s)) for run, q, d, s in runs], "run string, query_id string, passage_id string, score double")
    j = spark.createDataFrame([(q, P + str(d), h, p) for q, d, h, p in judged], "query_id string, passage_id string, human int, predicted int")
    return {(x.run, x.source, x.query_id, x.metric): x.value for x in ranking.metrics_per_query(r, j).collect()}


def test_equal_scores_go_by_id_descending(spark):
    got = scores(spark, [("a", "1", 1, 0.5), ("a", "1", 2, 0.5)], [("1", 1, 3, 3)])
    assert got["a", "human", "1", "AP(rel=2)"] == 0.5


def test_ideal_counts_passages_that_were_not_retrieved(spark):
    got = scores(spark, [("a", "1", 2, 1.0)], [("1", 1, 3, 3), ("1", 2, 2, 2), ("1", 3, 0, 0)])
    assert got["a", "human", "1", "nDCG@10"] == pytest.approx(2 / (3 + 2 / math.log2(3)))


def test_unjudged_keep_their_place(spark):
    got = scores(spark, [("a", "1", 9, 2.0), ("a", "1", 1, 1.0)], [("1", 1, 3, 3)])
    assert got["a", "human", "1", "AP(rel=2)"] == 0.5
    assert got["a", "human", "1", "nDCG@10"] == pytest.approx(1 / math.log2(3))


def test_queries_without_relevant_passages_and_without_results(spark):
    got = scores(spark, [("a", "1", 1, 1.0), ("a", "nobody", 1, 1.0), ("b", "2", 2, 1.0)], [("1", 1, 1, 0), ("2", 2, 2, 3)])
    assert got["a", "human", "1", "AP(rel=2)"] == 0 and got["a", "human", "1", "nDCG@10"] == 1
    assert got["a", "predicted", "1", "nDCG@10"] == 0
    assert got["b", "human", "1", "nDCG@100"] == 0 and ("a", "human", "nobody", "nDCG@10") not in got


def test_ideal_order_scores_one_and_order_of_rows_is_irrelevant(spark):
    judged = [("1", d, d % 4, 3 - d % 4) for d in range(30)]
    runs = [("best", "1", d, d % 4) for d in range(30)]
    got = scores(spark, runs, judged)
    assert [got["best", "human", "1", m] for m in ranking.METRICS] == pytest.approx([1, 1, 1])
    assert got == pytest.approx(scores(spark, runs[::-1], judged[::-1]))


def test_float_precision_makes_close_scores_tie(spark):
    runs = spark.createDataFrame([("a", "1", "x1", 1.0 + 1e-12), ("a", "1", "x2", 1.0)], "run string, query_id string, passage_id string, score double")
    assert ranking.ranked(runs).where("rank = 1").first().passage_id == "x1"
    assert ranking.ranked(runs, "float").where("rank = 1").first().passage_id == "x2"


def _summary(spark, pairs):
    rows = spark.createDataFrame(pairs, "human_relevance int, predicted_relevance int")
    return agreement.summary(agreement.confusion(rows)).first()


def test_kappa(spark):
    s = _summary(spark, [(0, 0)] * 3 + [(1, 1)] * 2 + [(0, 1)])
    assert s.cohen_kappa == pytest.approx((5 / 6 - 18 / 36) / (1 - 18 / 36)) and list(s.human_support) == [4, 2, 0, 0]
    assert _summary(spark, [(0, 0), (2, 2), (3, 3)]).cohen_kappa == 1
    one = _summary(spark, [(2, 2)] * 4)
    assert one.cohen_kappa is None and one.undefined_reason == NO_VARIATION


def test_normalized_rows_sum_to_one_or_zero(spark):
    cells = agreement.normalized(agreement.confusion(spark.createDataFrame([(0, 1), (0, 0), (2, 3)], "human_relevance int, predicted_relevance int")))
    sums = {r[0]: r[1] for r in cells.groupBy("human_relevance").agg(F.sum("share")).collect()}
    assert sums == {0: 1.0, 1: 0.0, 2: 1.0, 3: 0.0} and cells.count() == 16


def _tau(spark, human, predicted):
    rows = [(f"r{i:02}", "m", float(h), float(p)) for i, (h, p) in enumerate(zip(human, predicted, strict=True))]
    return correlation.with_p_values(correlation.kendall(spark.createDataFrame(rows, "run string, metric string, human double, predicted double"))).first()


def test_tau(spark):
    assert _tau(spark, range(5), range(5)).tau_b == 1
    assert _tau(spark, range(5), range(5)).p_value == pytest.approx(2 / math.factorial(5))
    assert _tau(spark, [1, 2, 3, 4], [1, 3, 2, 4]).tau_b == pytest.approx(4 / 6)
    a, b = _tau(spark, [1, 2, 2, 3], [1, 2, 3, 3]), _tau(spark, [1, 2, 3, 3], [1, 2, 2, 3])
    assert a.tau_b == b.tau_b and a.p_value == b.p_value
    flat = _tau(spark, [1, 2], [5, 5])
    assert flat.tau_b is None and flat.p_value is None and flat.undefined_reason == CONSTANT
    assert _tau(spark, [1, 2], [1, 2]).tau_b == 1


def test_exact_p_values():
    assert correlation.exact_p(4, 0) == pytest.approx(2 / 24)
    assert correlation.exact_p(3, 1) == pytest.approx(1.0)
    assert correlation.p_value(40, 0, 0, 0.0) == pytest.approx(1.0) and correlation.p_value(5, 0, 1, None) is None


def test_usage_and_cost(spark):
    rows = spark.createDataFrame([((10, None),), ((5, 2),), (None,)], "usage struct<input_tokens: bigint, output_tokens: bigint>")
    u = usage.usage_and_cost(rows, "gpt-6-luna").first()
    assert (u.input_tokens, u.output_tokens, u.judgments_with_usage, u.judgments_without_usage, u.complete) == (5, 2, 1, 2, False)
    assert u.total_cost == pytest.approx((5 * 0.1 + 2 * 0.5) / 1e6)
    none = usage.usage_and_cost(rows, "unknown").first()
    assert none.total_cost is None and none.undefined_reason == "No token prices configured for unknown"
    assert usage.usage_and_cost(rows.limit(0), "probabilistic").first().input_tokens == 0
