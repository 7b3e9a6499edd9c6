"""Agreement of two assessors over the grades 0 to 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradus.schemas import GRADES

# Fixed value: the reason that a report gives for a kappa that isn't defined.
NO_VARIATION = "No variation in either assessor"


def _cells(spark: SparkSession) -> DataFrame:
    grades = spark.range(len(GRADES) ** 2)
    return grades.select(F.floor(F.col("id") / len(GRADES)).cast("int").alias("human_relevance"), (F.col("id") % len(GRADES)).cast("int").alias("predicted_relevance"))


def confusion(judgments: DataFrame) -> DataFrame:
    """All 16 cells: human_relevance (rows), predicted_relevance (columns), n, zeros included."""
    keys = ["human_relevance", "predicted_relevance"]
    counts = judgments.groupBy(*keys).agg(F.count("*").alias("n"))
    return _cells(judgments.sparkSession).join(counts, keys, "left").select(*keys, F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def normalized(cells: DataFrame) -> DataFrame:
    """The confusion cells with share: of their row, 0 in an empty row."""
    row = F.sum("n").over(W.partitionBy("human_relevance"))
    return cells.withColumn("share", F.coalesce(F.try_divide(F.col("n").cast("double"), row.cast("double")), F.lit(0.0)))


def summary(cells: DataFrame) -> DataFrame:
    """One row: count, agree_count, exact_agreement, chance_agreement, cohen_kappa, undefined_reason and both supports.

    One aggregate of the cells gives the sums and both marginals. Kappa is null, with a reason, if chance agreement is 1;
    that is decided in whole numbers.
    """
    held = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    marginal = lambda side: F.array(*[held(F.col(side) == g) for g in GRADES])
    one = cells.agg(
        F.sum("n").alias("count"), held(F.col("human_relevance") == F.col("predicted_relevance")).alias("agree_count"),
        marginal("human_relevance").alias("human_support"), marginal("predicted_relevance").alias("method_support"),
    )
    chance = F.aggregate(F.zip_with("human_support", "method_support", lambda a, b: a * b), F.lit(0).cast("bigint"), lambda a, b: a + b)
    one = one.withColumn("_c", chance).withColumn("_n", F.col("count") * F.col("count"))
    p_o, p_e = F.try_divide(F.col("agree_count").cast("double"), F.col("count").cast("double")), F.try_divide(F.col("_c").cast("double"), F.col("_n").cast("double"))
    return one.select(
        "count", "agree_count", p_o.alias("exact_agreement"), p_e.alias("chance_agreement"), F.when(F.col("_c") < F.col("_n"), (p_o - p_e) / (1 - p_e)).alias("cohen_kappa"),
        F.when(F.col("_c") == F.col("_n"), F.lit(NO_VARIATION)).alias("undefined_reason"), "human_support", "method_support",
    )
