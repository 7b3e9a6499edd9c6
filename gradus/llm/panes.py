"""Hourly panes of a stream with late rows: emitted once their grace is over, revised while they are open, then closed.

Event time has no zone and counts microseconds from 1970; it may be negative. Of each batch the watermark W is the largest
event time of all earlier batches (none: minus infinity). A pane, a kind and an hour, is due when W reaches the hour's end
and the grace, and closed when W reaches its end and the closing time.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessorHandle, TimerValues

from gradus.llm._store import shared_dir

HOUR_MS, HOUR_US = 3_600_000, 3_600_000_000
#: Spark's watermark starts at 1970 and never falls, so event times move up by this many days; every one is above 0 then.
SHIFT_DAYS = 1_000_000
SHIFT_MS = SHIFT_DAYS * 24 * HOUR_MS
EVENTS = "kind STRING, us BIGINT, click_id BIGINT, cents BIGINT, last BOOLEAN"
#: SQL of a row's hour and day, rounded down.
HOURS = f"us div {HOUR_US} - IF(us % {HOUR_US} < 0, 1, 0)"
DAYS = "hour div 24 - IF(hour % 24 < 0, 1, 0)"
OUTPUT = "record STRING, kind STRING, hour BIGINT, click_id BIGINT, n_rows BIGINT, cents BIGINT"
#: A stream's own settings: state that supports timers, and a batch for each start and no other.
STREAM = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.streaming.stateStore.unloadOnCommit": "true"}


class Revisions(StatefulProcessor):
    """The panes of one kind and day: totals by hour, the hours with rows that no record has yet, and one timer.

    The timer stands at the earliest moment at which something is to be done: an hour of the set becomes due, or a pane
    closes. State is at most a day's hours for each kind that is still open, however many rows there are.
    """

    def __init__(self, grace_hours: int, closing_hours: int):
        self.grace, self.closing = grace_hours * HOUR_MS, closing_hours * HOUR_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.panes = handle.getMapState("panes", "hour BIGINT", "n_rows BIGINT, cents BIGINT, told_rows BIGINT, told_cents BIGINT")
        self.dirty = handle.getMapState("dirty", "hour BIGINT", "is BOOLEAN")
        self.timer = handle.getValueState("timer", "ms BIGINT")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        more: dict[int, tuple[int, int]] = {}
        last = False
        for r in rows:
            if r.n_rows:
                n, cents = more.get(r.hour, (0, 0))
                more[r.hour] = n + r.n_rows, cents + r.cents
            last |= r.last
        for hour, (n, cents) in more.items():
            had = self.panes.getValue((hour,)) or (0, 0, 0, 0)
            self.panes.updateValue((hour,), (had[0] + n, had[1] + cents, had[2], had[3]))
            self.dirty.updateValue((hour,), (True,))
        yield from self._turn(key[0], timerValues, last)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        yield from self._turn(key[0], timerValues, False)

    def _turn(self, kind: str, now: TimerValues, last: bool) -> Iterator[Row]:
        mark = now.getCurrentWatermarkInMs()
        reached = lambda hour, wait: mark > 0 and mark - SHIFT_MS >= (hour + 1) * HOUR_MS + wait
        row = lambda record, hour, n, cents: Row(record=record, kind=kind, hour=hour, click_id=-1, n_rows=n, cents=cents)
        waiting = []
        for (hour,) in sorted(self.dirty.keys()):
            if not last and not reached(hour, self.grace):
                waiting.append(hour)
                continue
            n, cents, told, told_cents = self.panes.getValue((hour,))
            if told:
                yield row("retract", hour, told, told_cents)
                yield row("replace", hour, n, cents)
            else:
                yield row("emit" if reached(hour, self.grace) else "final", hour, n, cents)
            self.panes.updateValue((hour,), (n, cents, n, cents))
            self.dirty.removeKey((hour,))
        held = [hour for (hour,) in self.panes.keys()]
        for hour in held:
            if reached(hour, self.closing):
                self.panes.removeKey((hour,))
        open_ = [hour for hour in held if not reached(hour, self.closing)]
        self._reschedule([(hour + 1) * HOUR_MS + self.grace for hour in waiting] + [(hour + 1) * HOUR_MS + self.closing for hour in open_])

    def _reschedule(self, deadlines: list[int]) -> None:
        at = min(deadlines) + SHIFT_MS - 1 if deadlines else None  # a timer may need a watermark beyond it; W has the last word
        was = self.timer.get()
        if was and was[0] != at:
            self.handle.deleteTimer(was[0])
        if at is None:
            if was:
                self.timer.clear()
        elif not was or was[0] != at:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def close(self) -> None:
        pass


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task summed for each pane before they are dealt out, so that a hot kind costs no more than its hours."""
    keys = ["kind", "day", "hour"]
    held, wait = None, []

    def total(parts: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(parts).group_by(keys, use_threads=False).aggregate([("n_rows", "sum"), ("cents", "sum"), ("last", "max")])
        return t.rename_columns({"n_rows_sum": "n_rows", "cents_sum": "cents", "last_max": "last"}).select([*keys, "n_rows", "cents", "last"])

    for batch in batches:
        # named anew, since Spark's columns may be declared without nulls and sums never are: only equal schemas can be joined
        wait.append(pa.table({c: batch.column(c) for c in [*keys, "n_rows", "cents", "last"]}))
        if len(wait) == 16:
            held, wait = total([held, *wait] if held else wait), []
            if held.num_rows > 100_000:  # very many kinds: no reason to keep them together
                yield from held.combine_chunks().to_batches()
                held = None
    if wait:
        held = total([held, *wait] if held else wait)
    if held:
        yield from held.combine_chunks().to_batches()


def revise(events: DataFrame, batches: int, *, grace_hours: int = 12, closing_hours: int = 48) -> DataFrame:
    """``events`` (batch, kind, us: event time, click_id, cents) to batch and ``OUTPUT``: late rows and the records of panes.

    The batches, 0 to ``batches`` - 1, are written to the shared folder and fed in their order to one stateful query that is
    started anew for each on the same checkpoint. In each, rows of closed panes are written as ``late``, one by one, and others
    added to their panes; then due panes that no batch has emitted are written as ``emit``, emitted ones with new rows as
    ``retract`` and ``replace``, and closed ones are forgotten. The last writes what is left as ``final``. A batch without rows
    does the same. No event at all gives no record. A null event time or kind isn't allowed; null cents are 0. Rows that
    repeat count as often. Other columns are ignored.

    Each batch is one micro-batch: what it wrote is replaced if it runs again, so a lost executor or a repeated batch doubles
    nothing. Nothing but each batch's largest event time goes to the driver.
    """
    spark = events.sparkSession
    folder = f"{shared_dir(spark)}/panes-{uuid.uuid4().hex}"
    given = events.select("batch", "kind", "us", "click_id", F.coalesce("cents", F.lit(0)).cast("bigint").alias("cents"), F.lit(False).alias("last"))
    given.write.partitionBy("batch").parquet(f"{folder}/given")
    rows = spark.read.schema(f"{EVENTS}, batch INT").parquet(f"{folder}/given")
    largest = dict(rows.groupBy("batch").agg(F.max("us")).collect())  # a row for each batch
    if not largest:
        return spark.createDataFrame([], f"batch BIGINT, {OUTPUT}")
    # in the last batch every kind and day has a row of no click, so that what is left of them is written
    ends = rows.withColumn("hour", F.expr(HOURS)).select("kind", F.expr(DAYS).alias("day")).distinct()
    ends = ends.select("kind", (F.col("day") * 24 * HOUR_US).alias("us"), F.lit(None).cast("bigint").alias("click_id"), F.lit(0).cast("bigint").alias("cents"), F.lit(True).alias("last"))
    ends.write.parquet(f"{folder}/ends")
    own = {k: spark.conf.get(k, None) for k in STREAM}
    try:
        for k, v in STREAM.items():
            spark.conf.set(k, v)
        mark = None
        for number in range(batches):
            _feed(spark, folder, number, last=number == batches - 1)
            _run(spark, folder, number, mark, grace_hours, closing_hours)
            mark = max((x for x in (mark, largest.get(number)) if x is not None), default=None)
    finally:
        for k, v in own.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(f"{OUTPUT}, batch BIGINT").parquet(f"{folder}/out").select("batch", *[c.split()[0] for c in OUTPUT.split(", ")])


def _feed(spark: SparkSession, folder: str, number: int, *, last: bool) -> None:
    """Move a batch to where the stream looks, complete at once; an empty batch is a file without rows."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path(f"{folder}/feed"))
    given, fed = path(f"{folder}/given/batch={number}"), path(f"{folder}/feed/batch={number}")
    if not system.exists(given):
        spark.createDataFrame([], EVENTS).coalesce(1).write.parquet(given.toString())
    if last:
        for status in system.globStatus(path(f"{folder}/ends/part-*")):
            system.rename(status.getPath(), path(f"{folder}/given/batch={number}/ends-{status.getPath().getName()}"))
    if not system.rename(given, fed):
        raise OSError(f"{given} can't be moved to {fed}")


def _run(spark: SparkSession, folder: str, number: int, mark: int | None, grace_hours: int, closing_hours: int) -> None:
    """One start of the query, which takes batch ``number`` and ends; ``mark`` is its watermark in microseconds."""
    closed = -SHIFT_DAYS * 24 if mark is None else mark // HOUR_US - closing_hours  # hours below this one are closed
    at = F.timestamp_micros(F.col("us") + F.lit(SHIFT_MS * 1000))
    rows = spark.readStream.schema(f"{EVENTS}, batch INT").parquet(f"{folder}/feed").withColumn("at", at).withWatermark("at", "0 seconds")
    # by the event time itself, so that both halves of the query see all rows go by and agree on the watermark
    late = F.col("at") < F.timestamp_micros(F.lit(closed * HOUR_US + SHIFT_MS * 1000))
    hours = rows.withColumn("hour", F.expr(HOURS)).withColumn("day", F.expr(DAYS))
    singly = hours.where(late & ~F.col("last")).select(F.lit("late").alias("record"), "kind", "hour", "click_id", F.lit(1).cast("bigint").alias("n_rows"), "cents")
    counted = hours.where(~late | F.col("last")).select("kind", "day", "hour", F.when(F.col("last"), 0).otherwise(1).cast("bigint").alias("n_rows"), "cents", "last")
    totals = counted.mapInArrow(_totals, counted.schema)
    records = totals.groupBy("kind", "day").transformWithState(Revisions(grace_hours, closing_hours), OUTPUT, "append", "eventtime")

    def put(found: DataFrame, batch: int) -> None:
        if batch != number:
            raise RuntimeError(f"batch {number} ran as {batch}")
        found.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = singly.unionByName(records).writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        with contextlib.suppress(Exception):
            query.stop()


def click_batches(clicks: DataFrame, batches: int = 10) -> DataFrame:
    """``clicks`` (click_id, ts, arrived_at, kind, value) to the events of a replay in ``batches`` batches.

    Rows without ts are dropped; a click_id counts once, by its earliest arrival (then ts, kind and value; rows without an id
    are clicks of their own each). A click's batch is its day of arrival modulo ``batches``, for 6 in 30 of them some batches
    later, by the checksum of the id; its event time is ts less the days that this moves the arrival. Without arrived_at, ts is
    taken as the arrival. A null kind is ``none``; cents are the value's hundredths, rounded half up, 0 if it is null, not
    finite or beyond a whole number. Extra columns are ignored.
    """
    us = lambda c: F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', CAST({c} AS TIMESTAMP_NTZ))")
    value = F.when(F.abs("value") < 9e16, F.floor(100 * F.col("value") + 0.5)).cast("bigint")
    rows = clicks.where("ts IS NOT NULL").select(
        "click_id", F.coalesce(us("arrived_at"), us("ts")).alias("arrived"), us("ts").alias("us"), F.coalesce("kind", F.lit("none")).alias("kind"), F.coalesce(value, F.lit(0)).alias("cents"),
    )
    once = rows.where("click_id IS NOT NULL").groupBy("click_id").agg(F.min(F.struct("arrived", "us", "kind", "cents")).alias("c")).select("click_id", "c.*")
    rows = once.unionByName(rows.where("click_id IS NULL"))
    day = F.expr("arrived div 86400000000 - IF(arrived % 86400000000 < 0, 1, 0)")
    q = F.pmod(day, F.lit(batches))
    behind = F.greatest(F.lit(0), F.crc32(F.coalesce(F.col("click_id").cast("string"), F.lit(""))) % 30 - 23)
    return rows.select(F.least(F.lit(batches - 1), q + behind).cast("int").alias("batch"), "kind", (F.col("us") - (day - q) * 86_400_000_000).alias("us"), "click_id", "cents")
