"""Ranked-retrieval metrics of runs, for the grades of both assessors from one ranking.

Rankings go by score, descending; ties by passage id, descending. A passage without judgment counts as grade 0 and keeps
its place. Gain is linear; average precision takes grades of 2 and more as relevant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

METRICS = ("nDCG@10", "nDCG@100", "AP(rel=2)")
SOURCES = ("human", "predicted")
RELEVANT = 2


def ranked(runs: DataFrame, score_precision: str = "double") -> DataFrame:
    """``runs`` with rank (int, from 1). ``score_precision`` float makes scores tie that agree in single precision."""
    order = W.partitionBy("run", "query_id").orderBy(F.col("score").cast(score_precision).desc(), F.desc("passage_id"))
    return runs.withColumn("rank", F.row_number().over(order))


def top(runs: DataFrame, k: int) -> DataFrame:
    return ranked(runs).where(F.col("rank") <= k)


def _gain(grade: str, at_most: int) -> Column:
    return F.sum(F.when(F.col("rank") <= at_most, F.col(grade) / F.log2(F.col("rank") + 1)).otherwise(0.0))


def _ideal(judgments: DataFrame) -> DataFrame:
    """Per query: the best possible gains, and the number of relevant passages, of each source; one shuffle by query."""
    grades = F.array(*[F.struct(F.lit(s).alias("source"), F.col(s).alias("grade")) for s in SOURCES])
    rows = judgments.select("query_id", F.explode(grades).alias("g")).select("query_id", "g.*").repartition("query_id")
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "source").orderBy(F.desc("grade"))))
    sums = []
    for s in SOURCES:
        own = F.when(F.col("source") == s, F.col("grade"))
        sums += [F.sum(F.when(F.col("rank") <= k, F.coalesce(own, F.lit(0)) / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"ideal{k}_{s}") for k in (10, 100)]
        sums.append(F.count_if(own >= RELEVANT).alias(f"relevant_{s}"))
    return rows.groupBy("query_id").agg(*sums)


def metrics_per_query(runs: DataFrame, judgments: DataFrame, score_precision: str = "double") -> DataFrame:
    """run, source, query_id, metric, value: every run with every judged query, 0 where it retrieves nothing.

    ``judgments``: query_id, passage_id, human, predicted. Queries that weren't judged are dropped before the ranking.
    The grades are joined first, since ranks don't depend on them: then one shuffle, by run and query, serves the ranking,
    the running sums and the totals. The optimizer chooses side and size of the joins.
    """
    judged = judgments.select("query_id").distinct()
    rows = runs.join(judged, "query_id", "left_semi").join(judgments, ["query_id", "passage_id"], "left").fillna(0, list(SOURCES))
    graded = ranked(rows, score_precision)
    so_far = W.partitionBy("run", "query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = []
    for s in SOURCES:
        hit = F.when(F.col(s) >= RELEVANT, 1).otherwise(0)
        graded = graded.withColumn(f"precision_{s}", F.when(F.col(s) >= RELEVANT, F.sum(hit).over(so_far) / F.col("rank")).otherwise(0.0))
        sums += [_gain(s, 10).alias(f"gain10_{s}"), _gain(s, 100).alias(f"gain100_{s}"), F.sum(f"precision_{s}").alias(f"precision_{s}")]
    found = graded.groupBy("run", "query_id").agg(*sums)
    spine = runs.select("run").distinct().crossJoin(_ideal(judgments))  # systems by judged queries: the result's own rows
    wide = spine.join(found, ["run", "query_id"], "left")
    parts = []
    for s in SOURCES:
        for metric, over, under in zip(METRICS, (f"gain10_{s}", f"gain100_{s}", f"precision_{s}"), (f"ideal10_{s}", f"ideal100_{s}", f"relevant_{s}"), strict=True):
            value = F.coalesce(F.when(F.col(under) > 0, F.col(over) / F.col(under)), F.lit(0.0))
            parts.append(F.struct(F.lit(s).alias("source"), F.lit(metric).alias("metric"), value.alias("value")))
    return wide.select("run", "query_id", F.explode(F.array(*parts)).alias("m")).select("run", "m.source", "query_id", "m.metric", "m.value")


def macro_mean(per_query: DataFrame) -> DataFrame:
    """run, source, metric, value: the mean over all judged queries."""
    return per_query.groupBy("run", "source", "metric").agg(F.avg("value").alias("value"))
