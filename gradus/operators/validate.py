"""Checks as queries that return the rows that break them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructField, StructType

from gradus.schemas import GRADES


class InvalidData(ValueError):
    """Rows that break a check; up to ten are shown."""


def require_empty(violations: DataFrame, message: str) -> None:
    some = violations.limit(10).collect()
    if some:
        raise InvalidData(f"{message}: " + "; ".join(str(tuple(r)) for r in some))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count ``n``."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def outside(rows: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Rows without a partner in ``other``."""
    return rows.join(other.select(*keys).distinct(), list(keys), "left_anti")


def bad_grades(rows: DataFrame, *fields: str) -> DataFrame:
    """Rows with a grade that is null or outside the domain."""
    wrong = [~F.coalesce(F.col(f).isin(*GRADES), F.lit(False)) for f in fields]
    return rows.where(reduce(lambda a, b: a | b, wrong))


def orphans(queries: DataFrame, passages: DataFrame, qrels: DataFrame) -> DataFrame:
    """Judged pairs whose query or passage doesn't exist: query_id, passage_id, missing."""
    missing_query = outside(qrels, queries, "query_id").select("query_id", "passage_id", F.lit("query").alias("missing"))
    return missing_query.unionByName(outside(qrels, passages, "passage_id").select("query_id", "passage_id", F.lit("passage").alias("missing")))


def check_judgments(judgments: DataFrame) -> None:
    """Each pair once, both grades in the domain. A strict schema has already made other types null."""
    require_empty(duplicates(judgments, "query_id", "passage_id"), "Pairs with several judgments")
    require_empty(bad_grades(judgments, "human_relevance", "predicted_relevance").select("query_id", "passage_id", "human_relevance", "predicted_relevance"), "Grades outside the domain")


def collection_violations(queries: DataFrame, passages: DataFrame, qrels: DataFrame, *, all_judged: bool = True) -> DataFrame:
    """What breaks the rules of a collection: rule, and the id or the pair of ids at fault.

    Unique ids and pairs, grades in the domain, no unknown references; with ``all_judged`` no unjudged ids either.
    """
    pair = F.concat_ws(" ", "query_id", "passage_id")

    def broken(rule: str, rows: DataFrame, at: Column) -> DataFrame:
        return rows.select(F.lit(rule).alias("rule"), at.alias("at"))

    found = [
        broken("query id repeats", duplicates(queries, "query_id"), F.col("query_id")),
        broken("passage id repeats", duplicates(passages, "passage_id"), F.col("passage_id")),
        broken("pair repeats", duplicates(qrels, "query_id", "passage_id"), pair),
        broken("query of a pair is unknown", outside(qrels, queries, "query_id"), pair),
        broken("passage of a pair is unknown", outside(qrels, passages, "passage_id"), pair),
        broken("grade outside the domain", bad_grades(qrels, "relevance"), pair),
    ]
    if all_judged:
        found += [
            broken("query is never judged", outside(queries, qrels, "query_id"), F.col("query_id")),
            broken("passage is never judged", outside(passages, qrels, "passage_id"), F.col("passage_id")),
        ]
    return reduce(DataFrame.unionByName, found)


def check_collection(queries: DataFrame, passages: DataFrame, qrels: DataFrame, *, all_judged: bool = True) -> None:
    """No ``collection_violations``; with ``all_judged`` off, there must be queries at least."""
    require_empty(collection_violations(queries, passages, qrels, all_judged=all_judged), "The collection breaks its rules")
    if not all_judged and queries.isEmpty():
        raise InvalidData("The collection has no query")


def check_same_pairs(checkpoint: DataFrame, qrels: DataFrame, *, complete: bool = True) -> None:
    """No judgment beside the qrels; with ``complete`` none missing either."""
    pair = ("query_id", "passage_id")
    require_empty(outside(checkpoint, qrels, *pair).select(*pair), "Judgments of pairs that the qrels lack")
    if complete:
        require_empty(outside(qrels, checkpoint, *pair).select(*pair), "Pairs of the qrels without a judgment")


def _told(field: StructField) -> list[Column]:
    """What a row's hash takes of a field: a null must not be like nothing, at any depth."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (StructType, ArrayType, MapType)):
        c = F.to_json(F.struct(c), {"ignoreNullFields": "false"})
    return [F.isnull(c), c]


def digest(rows: DataFrame) -> DataFrame:
    """One row: the number of ``rows`` and two sums of their 64-bit hashes, alike for the same rows as often in any order.

    Hashes are summed where rows are read, so nothing is shuffled but the sums. Different tables have the same digest by chance
    once in 2 to the 128 tries; it is no defence against tables that are made to have it.
    """
    given = [c for f in rows.schema.fields for c in _told(f)]
    sums = [F.sum(F.xxhash64(F.lit(seed), *given).cast("decimal(38,0)")).alias(name) for seed, name in ((1, "a"), (2, "b"))]
    return rows.agg(F.count("*").alias("rows"), *sums)


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: whether both tables, of the same fields, have the same rows as often (same), and how many (left_rows, right_rows)."""
    a, b = (digest(d).select(F.struct("*").alias(n)) for d, n in ((left, "l"), (right, "r")))
    return a.crossJoin(b).select((F.col("l") == F.col("r")).alias("same"), F.col("l.rows").alias("left_rows"), F.col("r.rows").alias("right_rows"))  # one row each


def check_equal(left: DataFrame, right: DataFrame) -> None:
    """Same fields, same rows as often. Rows are only compared one by one if the tables' digests differ."""
    shape = [[(f.name, f.dataType) for f in d.schema] for d in (left, right)]
    if shape[0] != shape[1]:
        raise InvalidData(f"Schemas differ: {shape[0]} and {shape[1]}")
    # hashes tell 0.0 from -0.0 and types apart, so only equal digests decide
    if same_rows(left, right).first().same:
        return
    both = left.withColumn("_side", F.lit(1)).unionByName(right.withColumn("_side", F.lit(-1)))
    surplus = both.groupBy(*left.columns).agg(F.sum("_side").alias("surplus")).where("surplus <> 0")
    require_empty(surplus.select(*left.columns, F.when(F.col("surplus") > 0, "first").otherwise("second").alias("only_in")), "Rows of one table only")


def not_finite(rows: DataFrame, *fields: str) -> DataFrame:
    """Rows with NaN or an infinity, which no JSON document may hold."""
    return rows.where(reduce(lambda a, b: a | b, [F.coalesce(F.isnan(f) | (F.abs(f) == float("inf")), F.lit(False)) for f in fields]))


def check_finite(rows: DataFrame, *fields: str) -> None:
    require_empty(not_finite(rows, *fields), "Not finite")
