"""Kendall's tau-b between the system orders of two assessors."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the reason that a report gives for a correlation that isn't defined.
CONSTANT = "Constant system scores"


PLACES = 12


def paired(means: DataFrame) -> DataFrame:
    """run, metric, human, predicted from macro means.

    Sums of the same numbers in another order may differ in their last bits, which must not decide the order of systems
    that tie: scores are rounded to ``PLACES`` decimals.
    """
    pick = lambda s: F.round(F.max(F.when(F.col("source") == s, F.col("value"))), PLACES).alias(s)
    return means.groupBy("run", "metric").agg(pick("human"), pick("predicted"))


def _ties(systems: DataFrame, side: str) -> DataFrame:
    """Per metric: tied pairs of a side and the sums that the variance takes from its tied groups."""
    groups = systems.groupBy("metric", side).agg(F.count("*").alias("t"))
    t = F.col("t")
    return groups.groupBy("metric").agg(
        F.sum((t * (t - 1) / 2).cast("bigint")).alias(f"tied_{side}"), F.sum(t * (t - 1) * (t - 2)).alias(f"zero_{side}"), F.sum(t * (t - 1) * (2 * t + 5)).alias(f"one_{side}"),
    )


def kendall(systems: DataFrame) -> DataFrame:
    """Per metric: system_count, difference (concordant less discordant), tied pairs, tau_b, z and undefined_reason.

    Systems are few, so pairs of them are a small join on the metric; tau_b is null, with a reason, if a side is constant.
    """
    a, b = systems.alias("a"), systems.alias("b")
    pairs = a.join(b, (F.col("a.metric") == F.col("b.metric")) & (F.col("a.run") < F.col("b.run")))
    sign = F.signum(F.col("a.human") - F.col("b.human")) * F.signum(F.col("a.predicted") - F.col("b.predicted"))
    moved = pairs.groupBy(F.col("a.metric").alias("metric")).agg(F.sum(sign).cast("bigint").alias("difference"))
    count = systems.groupBy("metric").agg(F.count("*").alias("system_count"))
    s = count.join(moved, "metric", "left").join(_ties(systems, "human"), "metric").join(_ties(systems, "predicted"), "metric").fillna(0, ["difference"])
    n = F.col("system_count")
    all_pairs = (n * (n - 1) / 2).cast("bigint")
    product = (all_pairs - F.col("tied_human")).cast("double") * (all_pairs - F.col("tied_predicted")).cast("double")
    m = (n * (n - 1)).cast("double")
    rest = F.when(n > 2, F.col("zero_human") * F.col("zero_predicted") / (9 * m * (n - 2))).otherwise(0.0)
    variance = (m * (2 * n + 5) - F.col("one_human") - F.col("one_predicted")) / 18 + 2 * F.col("tied_human") * F.col("tied_predicted") / m + rest
    s = s.withColumn("_p", product).withColumn("_v", F.when(m > 0, variance).otherwise(0.0))
    return s.select(
        "metric", "system_count", "difference", "tied_human", "tied_predicted", F.when(F.col("_p") > 0, F.col("difference") / F.sqrt("_p")).alias("tau_b"),
        F.when((F.col("_p") > 0) & (F.col("_v") > 0), F.col("difference") / F.sqrt("_v")).alias("z"), F.when(F.col("_p") <= 0, F.lit(CONSTANT)).alias("undefined_reason"),
    )


def exact_p(n: int, discordant: int) -> float:
    """Two-sided p-value without ties: the share of orders of ``n`` with so few, or so many, inversions."""
    counts = [1]
    for k in range(2, n + 1):
        grown = [0] * (len(counts) + k - 1)
        for i, c in enumerate(counts):
            for j in range(k):
                grown[i + j] += c
        counts = grown
    fewer = min(discordant, n * (n - 1) // 2 - discordant)
    return min(1.0, 2 * sum(counts[: fewer + 1]) / math.factorial(n))


def p_value(n: int, difference: int, tied: int, z: float | None) -> float | None:
    """Exact without ties for up to 33 systems, or if one pair at most is out of order; else by the normal distribution."""
    if z is None:
        return None
    pairs = n * (n - 1) // 2
    discordant = (pairs - difference) // 2
    if not tied and (n <= 33 or min(discordant, pairs - discordant) <= 1):
        return exact_p(n, discordant)
    return math.erfc(abs(z) / math.sqrt(2))


def with_p_values(taus: DataFrame) -> DataFrame:
    """``taus`` with p_value; a Pandas UDF, since no SQL function has the error function."""

    @F.pandas_udf("double")
    def p(n: pd.Series, difference: pd.Series, tied: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([p_value(int(a), int(b), int(c), None if pd.isna(d) else float(d)) for a, b, c, d in zip(n, difference, tied, z, strict=True)], dtype="float64")

    return taus.withColumn("p_value", p("system_count", "difference", F.col("tied_human") + F.col("tied_predicted"), "z"))
