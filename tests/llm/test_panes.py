"""Panes against a plain replay in Python."""

from __future__ import annotations

import datetime
import random
from collections import Counter

from gradus.llm import panes

HOUR = 3_600_000_000
SCHEMA = "batch int, kind string, us bigint, click_id bigint, cents bigint"


def replay(rows, batches, grace=12, closing=48):
    """Rows (batch, kind, us, click_id, cents) as the docstring says, batch by batch."""
    out, held, told, mark = [], {}, {}, None
    reached = lambda hour, wait: mark is not None and mark >= (hour + 1 + wait) * HOUR
    for b in range(batches):
        dirty = set()
        for _, kind, us, click, cents in [r for r in rows if r[0] == b]:
            hour, cents = us // HOUR, cents or 0
            if reached(hour, closing):
                out.append((b, "late", kind, hour, click, 1, cents))
            else:
                n, c = held.get((kind, hour), (0, 0))
                held[kind, hour] = n + 1, c + cents
                dirty.add((kind, hour))
        for key, (n, c) in sorted(held.items()):
            if key in told and key in dirty:
                out += [(b, "retract", *key, -1, *told[key]), (b, "replace", *key, -1, n, c)]
                told[key] = n, c
            elif key not in told and reached(key[1], grace):
                out.append((b, "emit", *key, -1, n, c))
                told[key] = n, c
            elif key not in told and b == batches - 1:
                out.append((b, "final", *key, -1, n, c))
        for key in [k for k in held if reached(k[1], closing)]:
            del held[key]
        mark = max([r[2] for r in rows if r[0] == b] + ([] if mark is None else [mark]), default=None)
    return Counter(out)


def got(spark, rows, batches):
    found = panes.revise(spark.createDataFrame(rows, SCHEMA), batches)
    assert found.columns == ["batch", "record", "kind", "hour", "click_id", "n_rows", "cents"]
    return Counter(map(tuple, found.collect()))


def test_replay(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        day = rng.choice([0, 0, 0, 1, 2, 4])
        rows.append((day, rng.choice(["a", "a", "b", ""]), (day - 1) * 26 * HOUR + rng.randrange(-30 * HOUR, 24 * HOUR), rng.choice([i, None, 7]), rng.choice([1, -5, None, 10**12])))
    rows += [(1, "a", -1, 900, 1), (2, "b", 70 * HOUR, 904, 1), (2, "a", 40 * HOUR, 905, 1), (4, "a", 40 * HOUR + 7, 906, 5), (2, "a", -HOUR, 901, 1), (4, "a", 12 * HOUR, 902, 2), (4, "only once", 200 * HOUR, 903, 3)] + [rows[3]] * 3
    want = replay(rows, 5)  # batch 3 is empty
    assert {"late", "emit", "retract", "replace", "final"} == {r[1] for r in want} and any(r[0] == 3 for r in want) and any(r[3] < 0 for r in want)
    assert got(spark, rows, 5) == want


def test_exact_deadlines(spark):
    """An hour that the watermark just reaches is due, or closed; a microsecond less isn't."""
    rows = [(0, "a", HOUR - 1, 1, 1), (0, "b", 13 * HOUR - 1, 2, 1), (1, "b", 13 * HOUR, 3, 1), (2, "a", 5, 4, 1), (2, "b", 49 * HOUR - 1, 8, 0), (3, "a", 6, 5, 1), (3, "b", 49 * HOUR, 6, 1), (4, "a", 7, 7, 1)]
    want = replay(rows, 5)
    assert (2, "emit", "a", 0, -1, 2, 2) in want and (3, "retract", "a", 0, -1, 2, 2) in want and (4, "late", "a", 0, 7, 1, 1) in want
    assert got(spark, rows, 5) == want


def test_no_rows(spark):
    assert got(spark, [], 2) == Counter()
    own = {k: spark.conf.get(k, None) for k in panes.STREAM}
    assert got(spark, [(0, "a", 5, 1, 2)], 1) == {(0, "final", "a", 0, -1, 1, 2): 1}
    assert own == {k: spark.conf.get(k, None) for k in panes.STREAM}


def test_totals_of_a_task():
    """Rows of a pane meet before the shuffle, also where a task has very many kinds."""
    import pyarrow as pa

    def batch(kinds):
        n = len(kinds)
        return pa.RecordBatch.from_pydict({"kind": kinds, "day": [0] * n, "hour": [3] * n, "n_rows": [1] * n, "cents": [2] * n, "last": [False] * n})

    hot = list(panes._totals(iter([batch(["a"] * 50)] * 40)))
    assert sum(b.num_rows for b in hot) == 1 and hot[0].to_pylist()[0] == {"kind": "a", "day": 0, "hour": 3, "n_rows": 2000, "cents": 4000, "last": False}
    many = list(panes._totals(iter([batch([f"{j}-{i}" for i in range(10_000)]) for j in range(20)])))
    assert sum(b.num_rows for b in many) == 200_000
    assert list(panes._totals(iter([]))) == []


def test_task_of_many_batches(spark):
    """A task goes on after its first sums, whose columns may hold nulls where those of Spark's rows may not."""
    n = 200_000  # 20 Arrow batches in one task
    events = spark.range(0, n, 1, 1).selectExpr("0 AS batch", "IF(id % 4 = 0, 'b', 'a') AS kind", f"(id % 5 - 2) * {HOUR} AS us", "id AS click_id", "IF(id % 7 = 0, NULL, id) AS cents")
    want = {}
    for i in range(n):
        key = "b" if i % 4 == 0 else "a", i % 5 - 2
        rows, cents = want.get(key, (0, 0))
        want[key] = rows + 1, cents + (i if i % 7 else 0)
    assert {(r.kind, r.hour): (r.n_rows, r.cents) for r in panes.revise(events, 1).collect()} == want


def test_clicks_with_odd_rows(spark):
    at = lambda day, hour=0: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day, hours=hour)
    rows = [
        (1, at(0), at(1), "view", 1.005, "x"), (1, at(0), at(0, 5), "click", 2.0, "y"), (1, at(0), at(0, 5), "click", 2.0, "y"),  # one click, its earliest arrival
        (2, None, at(0), "view", 1.0, "x"), (3, at(0), None, None, None, None), (None, at(0), at(0), "view", float("nan"), ""), (None, at(0), at(0), "view", float("-inf"), ""),
        (4, at(5), at(5), "view", 1e300, ""), (5, at(-20000), at(-20000, 3), "view", -0.006, ""),
    ]
    found = panes.click_batches(spark.createDataFrame(rows, "click_id bigint, ts timestamp, arrived_at timestamp, kind string, value double, hour string")).collect()
    by = Counter(r.click_id for r in found)
    assert by == {1: 1, 3: 1, None: 2, 4: 1, 5: 1}
    one = {r.click_id: r for r in found}
    assert one[1].kind == "click" and one[1].cents == 200 and one[3].kind == "none" and one[3].cents == 0 and one[None].cents == 0 and one[4].cents == 0 and one[5].cents == -1
    assert all(0 <= r.batch <= 9 for r in found)
    assert panes.click_batches(spark.createDataFrame([], "click_id bigint, ts timestamp, arrived_at timestamp, kind string, value double")).count() == 0
