"""Positions and fingerprints along a total order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradus.sources import tables

FAN = 256  # digests that one node of a tree takes


def in_ranges(rows: DataFrame, *order: str | Column, part: str = "_part") -> DataFrame:
    """``rows`` with the number of their range along ``order``, which rises with it. Ranges are sampled, so they are written down."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tables.kept(rows.repartitionByRange(tasks, *order).withColumn(part, F.spark_partition_id()), "ranges")


def with_positions(rows: DataFrame, *order: str | Column, name: str = "position") -> DataFrame:
    """``rows`` with their place from 0 along ``order``, which should tell all rows apart: equal rows get places in any order.

    Each range numbers its rows; what comes before a range is the sum of the counts of those before, a row for each range.
    """
    ranged = in_ranges(rows, *order)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select(F.col("_part").alias("_p"), (F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_size")).alias("_before"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    placed = ranged.withColumn("_own", own).join(before, F.col("_part") == F.col("_p"))
    return placed.select(*rows.columns, (F.col("_before") + F.col("_own") - 1).cast("bigint").alias(name))


def line(*columns: str) -> Column:
    """A row as one text from which its values can be told: a null is a lone N, a value is its length, a colon and itself."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("N"))
    return F.concat(*[one(c) for c in columns])


def fingerprint(rows: DataFrame, order: list[str], columns: list[str]) -> str:
    """SHA-256 in hex of ``columns`` in the order of ``order``: a tree of digests over runs of ``FAN`` rows, then of nodes.

    It changes with any value and with the order, but not with how rows are partitioned. No row gives the digest of nothing.
    A node takes ``FAN`` digests, so no task or driver holds more than that of a group, and the tree is as high as the
    logarithm of the rows.
    """
    nodes = with_positions(rows, *order).select(F.col("position").alias("i"), F.sha2(line(*columns), 256).alias("d"))
    while True:
        inner = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "d"))), lambda x: x["d"]), ""), 256)
        nodes = tables.kept(nodes.groupBy(F.floor(F.col("i") / FAN).cast("bigint").alias("i")).agg(inner.alias("d")), "tree")
        some = nodes.limit(2).collect()
        if len(some) < 2:
            return some[0].d if some else NOTHING


NOTHING = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
