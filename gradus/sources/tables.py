"""Tables of a judged collection in a folder of Parquet tables, and JSON documents beside them.

Folders are paths that Spark resolves, so documents lie in the same file system as the tables.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.operators.validate import InvalidData, check_equal
from gradus.sources import archives

NAMES = ("queries", "passages", "qrels")
KEYS = {"queries": ["query_id"], "passages": ["passage_id"], "qrels": ["query_id", "passage_id"]}


def _manifest(folder: str, revision: str | None) -> str:
    return f"{folder}/revisions/{revision}.json" if revision else f"{folder}/tables.json"


def _known(folder: str, revision: str | None) -> dict[str, str]:
    """The folder of each table that a collection has: those that its manifest names, or whole ones where there is none."""
    if listed := load_json(_manifest(folder, revision)):
        return {name: f"{folder}/{path}" for name, path in listed.items()}
    plain = f"{folder}/revisions/{revision}" if revision else folder
    return {name: f"{plain}/{name}" for name in NAMES if exists(f"{plain}/{name}/_SUCCESS")}


def read_collection(spark: SparkSession, folder: str, revision: str | None = None) -> dict[str, DataFrame]:
    """The three tables; with ``revision`` those that were published under that name. A table that isn't there raises."""
    known = _known(folder, revision)
    if missing := [name for name in NAMES if name not in known]:
        raise InvalidData(f"{folder} has no {', '.join(missing)}" + (f" of revision {revision}" if revision else ""))
    return {name: spark.read.parquet(known[name]) for name in NAMES}


def write_collection(tables: dict[str, DataFrame], folder: str, revision: str | None = None) -> None:
    """Publish each table that isn't there yet, sorted by its keys; one that is there must have the same rows.

    New tables are written aside, read back and compared; then one renamed manifest makes all of them visible. What a broken
    run leaves is never seen, and another run starts anew. Of two that publish at once the later one's manifest holds.
    """
    spark = next(iter(tables.values())).sparkSession
    known, aside = _known(folder, revision), f"data/{uuid.uuid4().hex}"
    new = {}
    for name, rows in tables.items():
        path = known.get(name)
        if path is None:
            path, new[name] = f"{folder}/{aside}/{name}", f"{aside}/{name}"
            rows.orderBy(*KEYS[name]).write.parquet(path)
        check_equal(rows, spark.read.parquet(path))
    if new:
        save_json(_manifest(folder, revision), {**{name: path.removeprefix(f"{folder}/") for name, path in known.items()}, **new})


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir, which a cluster must set; one of our own only on a single machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        shared = tempfile.mkdtemp(prefix="gradus-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to a new folder of ``scratch`` and read again: alike from then on, whatever executors are lost."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_files(lines: DataFrame, folder: str) -> list[str]:
    """Text files from ``lines`` (file, place, line): one for each file name, its lines by place; their paths, in order.

    Each file is written by one task, so it must fit one; the names are few.
    """
    work = f"{folder}/parts"
    lines.repartition("file").sortWithinPartitions("file", "place").select("file", "line").write.partitionBy("file").text(work)
    jvm, _, own, system = hadoop(work)
    paths = []
    for status in system.globStatus(jvm.org.apache.hadoop.fs.Path(f"{work}/file=*/part-*")):
        name = status.getPath().getParent().getName().removeprefix("file=")
        paths.append(f"{folder}/{name}")
        system.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(paths[-1]))
    system.delete(own, True)
    return sorted(paths)


def hadoop(path: str):
    """The JVM, a Hadoop path and its file system."""
    spark = SparkSession.active()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    own = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, conf, own, own.getFileSystem(conf)


def exists(path: str) -> bool:
    _, _, own, system = hadoop(path)
    return system.exists(own)


def remove(path: str) -> None:
    _, _, own, system = hadoop(path)
    system.delete(own, True)


def save_json(path: str, value: object) -> None:
    """Replace a JSON document at once: written beside its place, then renamed. NaN and infinities are refused."""
    text = json.dumps(value, indent=2, allow_nan=False)
    jvm, conf, own, system = hadoop(path)
    beside = own.suffix(".partial")
    out = system.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = SparkSession.active().sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), conf).rename(beside, own, options)


def rename_new(source: str, target: str) -> bool:
    """Move a file to where none is; False if one is there, and then nothing is moved."""
    jvm, conf, own, system = hadoop(target)
    system.mkdirs(own.getParent())
    options = SparkSession.active().sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), conf).rename(jvm.org.apache.hadoop.fs.Path(source), own, options)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in str(error.java_exception):
            raise
        remove(source)
        return False
    return True


def load_json(path: str) -> dict:
    """One JSON object; an absent file is an empty one."""
    jvm, _, own, system = hadoop(path)
    if not system.exists(own):
        return {}
    given = system.open(own)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(given, "UTF-8"))
    finally:
        given.close()


def cached_files(spark: SparkSession, folder: str, names: list[str], fetch: Callable[[str], Iterable[bytes]], check: Callable[[str], object]) -> list[str]:
    """The paths of the named files in a folder that all executors see. What isn't there is fetched, a file a task, where the task runs.

    ``fetch`` yields a file's bytes. Each is written aside and renamed when it is whole, then ``check``, which raises for a
    faulty one, must let it pass before it gets its name; files that are there are checked as well, so nothing is used unseen.
    """
    paths = {n: f"{folder}/{n}" for n in names}
    missing = [n for n, path in paths.items() if not exists(path)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch["name"].to_pylist():
                system, inner = archives.opened(folder)
                system.create_dir(inner)
                aside = f"{inner}/.{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
                with system.open_output_stream(aside) as out:
                    for part in fetch(name):
                        out.write(part)
                system.move(aside, f"{inner}/partial-{name}")  # the same suffix: readers go by it
            yield batch

    if missing:
        spark.createDataFrame([(n,) for n in missing], "name string").repartition(len(missing)).mapInArrow(work, "name string").collect()
    try:
        for name, path in paths.items():
            check(f"{folder}/partial-{name}" if name in missing else path)
            if name in missing:
                rename_new(f"{folder}/partial-{name}", path)
    finally:
        for name in missing:
            remove(f"{folder}/partial-{name}")
    return [*paths.values()]


def copied(folder: str) -> Callable[[str], Iterable[bytes]]:
    """A ``fetch`` of files of a folder, in any file system that ``archives.opened`` knows."""

    def fetch(name: str) -> Iterator[bytes]:
        system, inner = archives.opened(f"{folder}/{name}")
        with system.open_input_stream(inner, compression=None) as given:
            while part := given.read(1 << 20):
                yield part

    return fetch


def manifest(spark: SparkSession, paths: list[str]) -> list[dict]:
    """File name and SHA-256 of each file, hashed where it is read."""
    files = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_name").alias("file"), F.sha2("content", 256).alias("sha256"))
    return [r.asDict() for r in files.orderBy("file").collect()]


def fingerprint(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()
