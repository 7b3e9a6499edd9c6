"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.llm._store import settle

TWO_52 = 4503599627370496.0


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from the hash of the seed and the keys; the same on every engine that has MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(TWO_52)


def source_rates(docs: DataFrame, weights: dict[str, float], *, default_weight: float = 1.0, epochs: float = 1.0, text: str = "text", source: str = "source") -> DataFrame:
    """Per source: its characters, its mean repetition rate and the cumulative Poisson distribution of that rate.

    The rate makes the expected characters of a source its share of ``epochs`` times all characters.
    A source without characters can't reach a share: its rate is 0. Null is a source of its own.
    """
    if min([default_weight, *weights.values()]) < 0 or epochs <= 0:
        raise ValueError("weights must not be negative, epochs must be positive")
    weight = F.lit(float(default_weight))
    for name, value in weights.items():
        weight = F.when(F.col("_source") == name, F.lit(float(value))).otherwise(weight)
    sums = docs.groupBy(F.col(source).alias("_source")).agg(F.sum(F.coalesce(F.length(text), F.lit(0))).alias("_chars"))
    sums = settle(sums.withColumn("_weight", weight), "source-sums")
    whole = sums.where("_chars > 0").agg(F.sum("_chars"), F.sum("_weight")).first()
    rate = F.lit(float(epochs)) * F.col("_weight") / F.lit(float(whole[1] or 1)) * F.lit(int(whole[0] or 0)) / F.col("_chars")
    rates = sums.withColumn("_rate", F.when((F.col("_chars") > 0) & F.lit((whole[1] or 0) > 0), rate).otherwise(0.0))
    cdf = F.expr("""
        CASE WHEN _rate > 0 THEN aggregate(
            sequence(1, CAST(ceil(_rate + 12 * sqrt(_rate) + 30) AS INT)),
            named_struct('l', -_rate, 'c', exp(-_rate), 'a', array(exp(-_rate))),
            (s, k) -> named_struct('l', s.l + ln(_rate / k), 'c', s.c + exp(s.l + ln(_rate / k)), 'a', concat(s.a, array(s.c + exp(s.l + ln(_rate / k))))),
            s -> s.a) END""")
    return rates.select("_source", "_chars", "_rate", cdf.alias("_cdf"))


def _prefix(docs: DataFrame) -> str:
    """Underscores that no column of ``docs`` begins with."""
    tag = "_"
    while any(c.startswith(tag) for c in docs.columns):
        tag += "_"
    return tag


def mix_sources(docs: DataFrame, weights: dict[str, float], *, seed: int = 17, default_weight: float = 1.0, epochs: float = 1.0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents, each repeated by a Poisson count of its source's rate, in a global random order.

    The count inverts the distribution at the hash of seed and id, so a run can be repeated after any loss.
    Columns: those of ``docs`` (one named copy_no, in capitals or not, is replaced), then ``copy_no`` (int, from 1). Null or
    empty texts are drawn as others of their source; rows that repeat are drawn alike; an empty table stays empty; all
    other columns are carried along.
    The rates have a row for each source: Spark broadcasts them only under its own size threshold, else it
    sort-merges, splitting a hot source.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "copy_no"])
    own, tag = [F.col(f"`{c}`") for c in docs.columns], _prefix(docs)
    rates = settle(source_rates(docs, weights, default_weight=default_weight, epochs=epochs, text=text, source=source), "source-rates")
    rates = rates.select(F.col("_source").alias(f"{tag}of"), F.col("_cdf").alias(f"{tag}cdf"))
    at = uniform(seed, F.col(doc_id))
    count = F.coalesce(F.size(F.filter(f"{tag}cdf", lambda c: c <= F.col(f"{tag}at"))), F.lit(0))
    drawn = docs.join(rates, F.col(source).eqNullSafe(F.col(f"{tag}of")), "left").withColumn(f"{tag}at", at)
    drawn = drawn.withColumn(f"{tag}n", F.when(F.col(f"{tag}cdf").isNull(), 0).otherwise(count)).where(F.col(f"{tag}n") > 0)
    out = drawn.select(*own, F.explode(F.sequence(F.lit(1), F.col(f"{tag}n"))).alias("copy_no"))
    place = f"{tag}place"
    out = out.withColumn(place, F.xxhash64(F.lit(seed), F.col(doc_id), F.col("copy_no")))
    return out.repartition(F.col(place)).sortWithinPartitions(place).drop(place)
