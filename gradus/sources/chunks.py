"""A log of chunks: rows are written aside, and one rename of a small entry makes a chunk part of the table, once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gradus.sources import tables


def log(path: str) -> dict[str, str]:
    """The folder of each chunk of the table at ``path``, in the order of their names; a row for each chunk, on the driver."""
    jvm, _, own, system = tables.hadoop(f"{path}/log")
    if not system.exists(own):
        return {}
    names = [s.getPath().getName() for s in system.listStatus(own)]
    return {n.removesuffix(".json"): f"{path}/{tables.load_json(f'{path}/log/{n}')['folder']}" for n in sorted(names) if n.endswith(".json")}


def append(rows: DataFrame, path: str, chunk: str, *partitions: str) -> bool:
    """Add ``rows`` as JSON under the name ``chunk``; False if the table has a chunk of that name, which then stays as it is.

    Whoever fails before the entry is renamed has added nothing: what was written is never read. Names can't be taken twice,
    since a rename without overwriting is refused where the entry stands.
    """
    if chunk in log(path):
        return False
    folder = f"data/chunk={chunk}/part={uuid.uuid4().hex}"
    rows.write.partitionBy(*partitions).json(f"{path}/{folder}")
    aside = f"{path}/.{uuid.uuid4().hex}.json"
    tables.save_json(aside, {"folder": folder})
    return tables.rename_new(aside, f"{path}/log/{chunk}.json")


def read_text(spark: SparkSession, path: str, partitions: str = "") -> DataFrame | None:
    """The lines of all chunks (value, chunk, and the columns ``partitions`` that they are parted by); None if there is no chunk."""
    known = log(path)
    if not known:
        return None
    schema = ", ".join(x for x in ("value STRING, chunk STRING, part STRING", partitions) if x)
    return spark.read.schema(schema).option("basePath", f"{path}/data").text([*known.values()]).drop("part")
