"""Judging a stream of pairs: each micro-batch is one durable chunk of the checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gradus.operators import judging
from gradus.sources import trec


def judge_stream(pairs: DataFrame, queries: DataFrame, passages: DataFrame, make_judge: Callable[[], judging.Judge], path: str, progress: str, *, concurrency: int = 16, trigger: dict | None = None, **paced) -> StreamingQuery:
    """Append judgments of streamed qrels to the checkpoint ``path``, failures among them; ``progress`` holds the offsets.

    A batch is a chunk of the checkpoint, visible once it is whole; one that runs again after a loss finds its chunk there and
    only asks for what was put off. ``trec.read_failures`` has the pairs that failed, with the batch as chunk. ``paced`` goes
    to ``judging.judge_chunks``.
    """

    def batch(rows: DataFrame, number: int) -> None:
        done = trec.read_judgments(rows.sparkSession, path)
        left = judging.pending(judging.inputs(rows.dropDuplicates(["query_id", "passage_id"]), queries, passages), done)
        judging.judge_chunks([(f"batch-{number:09}", left)], path, make_judge, tasks=concurrency, **paced)

    return pairs.writeStream.foreachBatch(batch).option("checkpointLocation", progress).trigger(**(trigger or {"availableNow": True})).start()
