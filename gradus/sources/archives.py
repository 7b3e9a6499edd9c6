"""Corpus shards inside tar archives, and single lines of shards by the byte at which they stand.

Archives and shards are opened by ``pyarrow.fs`` where they are read: a local or mounted path, or a URI of a file system that
it knows. Nothing is unpacked, and only headers are read to plan.
"""

from __future__ import annotations

import io
import itertools
import json
import os
import re
import tarfile
import uuid
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

CHUNK = 1 << 20
SPLIT = 128 << 20  # bytes of a part of a shard that isn't compressed
ROWS = 4096
GAP = 128 << 10  # two lines nearer than this are read at once
GUESS = 4 << 10  # bytes of a line, to begin with
LONGEST = 8 << 20  # of what is read at once


class Place(NamedTuple):
    """Where a shard lies: its file name without its folder, the file or archive, first byte, bytes, and whether it is gzip."""

    run: str
    path: str
    start: int
    size: int
    gzip: bool


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it (``file:/x``, ``file:///x``, ``/x``, ``hdfs://…``) and the path in it."""
    local = re.match(r"file:/*(/.*)", path)
    return fs.FileSystem.from_uri(path) if "://" in path and not local else (fs.LocalFileSystem(), local[1] if local else path)


def places(path: str) -> list[Place]:
    """The shards of a tar archive, by their headers, or the one that a file is. An archive that is cut short raises."""
    system, inner = opened(path)
    if not path.endswith(".tar"):
        return [Place(os.path.basename(path), path, 0, system.get_file_info(inner).size, path.endswith(".gz"))]
    try:
        with system.open_input_file(inner) as given, tarfile.open(fileobj=given, mode="r:") as archive:
            members = list(archive)
            given.seek(members[-1].offset_data + -(-members[-1].size // 512) * 512 if members else 0)
            if given.read(512) != bytes(512):
                raise ValueError(f"{path}: the archive has no end")
            return [Place(os.path.basename(m.name), path, m.offset_data, m.size, m.name.endswith(".gz")) for m in members if m.isfile()]
    except tarfile.ReadError as error:
        raise ValueError(f"{path}: {error}") from error


def content(path: str, start: int, size: int, gzip: bool) -> Iterator[bytes]:
    """What a shard holds from ``start`` on, uncompressed, piece by piece; one that ends early raises."""
    system, inner = opened(path)
    with system.open_input_file(inner) as given:
        given.seek(start)
        unpack, left = zlib.decompressobj(31) if gzip else None, size
        while left:
            got = given.read(min(CHUNK, left))
            if not got:
                raise ValueError(f"{path}: {left} bytes of a shard are missing")
            left -= len(got)
            while unpack and got:
                if part := unpack.decompress(got):
                    yield part
                got = unpack.unused_data
                if unpack.eof and (got or left):
                    unpack = zlib.decompressobj(31)
            if not unpack:
                yield got
        if unpack and not unpack.eof:
            raise ValueError(f"{path}: a shard's gzip data end early")


def lines(parts: Iterable[bytes], at: int = 0) -> Iterator[tuple[int, bytes]]:
    """Lines without their ends, and the byte at which each begins, counted from ``at``."""
    held = b""
    for part in parts:
        held += part
        *whole, held = held.split(b"\n")
        for line in whole:
            yield at, line
            at += len(line) + 1
    if held:
        yield at, held


class Part(InputPartition):
    """A shard, or the lines of one that isn't compressed which begin in a range of its bytes."""

    def __init__(self, place: Place, first: int, last: int):
        self.place, self.first, self.last = place, first, last


class TarReader(DataSourceReader):
    def __init__(self, path: str, members: Iterable[str] | None):
        self.path, self.members = path, None if members is None else set(members)

    def partitions(self) -> list[Part]:
        own = [p for p in places(self.path) if self.members is None or p.run in self.members]
        return [Part(p, lo, p.size if p.gzip else min(p.size, lo + SPLIT)) for p in own for lo in range(0, max(1, p.size), p.size + 1 if p.gzip else SPLIT)]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing was planned
            return
        p, lo = partition.place, partition.first
        given = lines(content(p.path, p.start, p.size, True)) if p.gzip else lines(content(p.path, p.start + max(0, lo - 1), p.size - max(0, lo - 1), False), max(0, lo - 1))
        if lo and not p.gzip:
            next(given, None)  # what begins before this part, if only by the line end in front of it
        rows: list[tuple[int, bytes]] = []
        for at, line in given:
            if not p.gzip and at >= partition.last:
                break
            rows.append((at, line))
            if len(rows) == ROWS:
                yield self._batch(p.run, rows)
                rows = []
        if rows:
            yield self._batch(p.run, rows)

    @staticmethod
    def _batch(run: str, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        offsets, text = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([run] * len(rows)), pa.array(offsets, pa.int64()), pa.array(text, pa.binary()).cast(pa.string())], ["run", "offset", "line"])


class FilteredTarReader(TarReader):
    """For sessions in which Spark hands filters to such sources; elsewhere it refuses a reader that takes them."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """``run`` equal to, or one of, some names decides which members are planned at all."""
        for f in filters:
            named = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if named is None or f.attribute != ("run",):
                yield f
            else:
                self.members = named if self.members is None else self.members & named


class TarLines(DataSource):
    """Lines of the shards of a tar archive: run (the member's name without folders), offset (in the uncompressed shard), line.

    A member is a partition, several if it isn't compressed. The option ``members``, a JSON list of names, or a filter on run
    (with the option ``filters``, where spark.sql.python.filterPushdown.enabled is on) leaves others out when the partitions are
    planned: no byte of them is read.
    """

    @classmethod
    def name(cls) -> str:
        return "tar_lines"

    def schema(self) -> str:
        return "run STRING, offset BIGINT, line STRING"

    def reader(self, schema) -> TarReader:
        members = self.options.get("members")
        kind = FilteredTarReader if self.options.get("filters") == "true" else TarReader
        return kind(self.options["path"], None if members is None else json.loads(members))


def tar_lines(spark: SparkSession, path: str, members: Iterable[str] | None = None) -> DataFrame:
    spark.dataSource.register(TarLines)
    given = spark.read.format("tar_lines").option("filters", spark.conf.get("spark.sql.python.filterPushdown.enabled"))
    return (given if members is None else given.option("members", json.dumps(sorted(members)))).load(path)


class _From:
    """A file read from some byte on, as if it began there."""

    def __init__(self, file: pa.NativeFile, start: int):
        self.file, self.start = file, start

    def seek(self, at: int) -> None:
        self.file.seek(self.start + at)

    def read(self, size: int) -> bytes:
        return self.file.read(size)


def lines_at(wanted: DataFrame, shards: list[Place]) -> DataFrame:
    """``wanted`` (run, offset, …) with line, null if the shard ends before it, and bytes, which were read for it.

    ``shards`` are one row each. In those that aren't compressed the offsets, sorted and dealt out by ranges, are read by
    seeking: lines that stand within ``GAP`` bytes of each other at once, others each alone, and nothing between. bytes stands
    at the first line of what was read at once. A compressed shard is unpacked by one task as far as its last offset. Offsets
    may repeat and needn't be the start of a line: what follows them up to the line's end is returned. Unknown runs are left out.
    """
    spark = wanted.sparkSession
    known = spark.createDataFrame([tuple(p) for p in shards], "run STRING, _path STRING, _start BIGINT, _size BIGINT, _gzip BOOLEAN")
    rows, columns = wanted.join(known, "run"), wanted.columns

    def together(given: _From, path: str, size: int, offsets: list[int]) -> Iterator[tuple[bytes | None, int]]:
        """Lines at offsets that are near each other, by one read; more only until the last line has its end."""
        first, last = offsets[0], offsets[-1]
        held = b""
        if first < size:
            given.seek(first)
            held, more = given.read(min(last + GUESS, size) - first), GUESS
            while b"\n" not in held[max(0, last - first) :] and first + len(held) < size:
                part = given.read(min(more, size - first - len(held)))
                if not part:
                    raise ValueError(f"{path}: a shard ends early")
                held, more = held + part, more * 2
        for k, offset in enumerate(offsets):
            at = offset - first
            stop = held.find(b"\n", at)
            yield (held[at:] if stop < 0 else held[at:stop]) if at < len(held) else None, 0 if k else len(held)

    def seek(path: str, start: int, size: int, offsets: Iterator[int]) -> Iterator[tuple[bytes | None, int]]:
        system, inner = opened(path)
        with system.open_input_file(inner) as file:
            given, near = _From(file, start), []
            for offset in offsets:
                if near and (offset - near[-1] > GAP or offset - near[0] >= LONGEST):
                    yield from together(given, path, size, near)
                    near = []
                near.append(offset)
            yield from together(given, path, size, near)

    def unpack(path: str, start: int, size: int, offsets: Iterator[int]) -> Iterator[tuple[bytes | None, int]]:
        parts, held, base, read = content(path, start, size, True), b"", 0, 0
        for offset in offsets:
            while base + len(held) <= offset or b"\n" not in held[max(0, offset - base) :]:
                part = next(parts, None)
                if part is None:
                    break
                if base + len(held) <= offset:  # nothing of it is wanted
                    base, held = base + len(held), b""
                held, read = held + part, read + len(part)
            if offset > base:
                held, base = held[offset - base :], offset
            stop = held.find(b"\n")
            yield (held if stop < 0 else held[:stop]) if held else None, read
            read = 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[pa.RecordBatch] = deque()

        def asked() -> Iterator[tuple]:
            for batch in batches:
                waiting.append(batch)
                yield from zip(*[batch[c].to_pylist() for c in ("_path", "_start", "_size", "_gzip", "offset")], strict=True)

        def answers() -> Iterator[tuple[bytes | None, int]]:
            for (path, start, size, packed), group in itertools.groupby(asked(), key=lambda r: r[:4]):
                yield from (unpack if packed else seek)(path, start, size, (r[4] for r in group))

        found: list[tuple[bytes | None, int]] = []
        for answer in answers():
            found.append(answer)
            if len(found) == waiting[0].num_rows:
                batch = waiting.popleft()
                line = pa.array([f[0] for f in found], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in columns], line, pa.array([f[1] for f in found], pa.int64())], [*columns, "line", "bytes"])
                found = []

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in wanted.schema.fields)}, line STRING, bytes BIGINT"
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    apart = rows.where("NOT _gzip").repartitionByRange(tasks, "_path", "_start", "offset").sortWithinPartitions("_path", "_start", "offset")
    packed = rows.where("_gzip").repartition("_path", "_start").sortWithinPartitions("_path", "_start", "offset")
    return apart.mapInArrow(work, schema).unionByName(packed.mapInArrow(work, schema))


def pack(text: DataFrame, folder: str, *, gzip: bool = True) -> list[str]:
    """Tar archives from ``text`` (file, place, line): one for each file name, with the file and a note beside it; their paths.

    Each archive is written by one task, compressed on the way, put aside and renamed once it is whole; the names are few.
    """
    spark = text.sparkSession

    def write(name: str, data: bytes) -> str:
        system, inner = opened(folder)
        system.create_dir(inner)
        aside, path = f"{inner}/.{uuid.uuid4().hex}", f"{inner}/{name}.tar"
        with system.open_output_stream(aside) as out:
            for member, held in (("corpus/README", b"shards\n"), (f"corpus/{name}{'.gz' if gzip else ''}", data)):
                info = tarfile.TarInfo(member)
                info.size = len(held)
                out.write(info.tobuf() + held + bytes(-len(held) % 512))
            out.write(bytes(1024))
        system.move(aside, path)
        return f"{folder}/{name}.tar"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, done = None, []
        for batch in batches:
            for file, line in zip(batch["file"].to_pylist(), batch["line"].to_pylist(), strict=True):
                if file != name:
                    if name is not None:
                        done.append(write(name, held.getvalue() + (squeeze.flush() if gzip else b"")))
                    name, held, squeeze = file, io.BytesIO(), zlib.compressobj(6, zlib.DEFLATED, 31)
                data = f"{line}\n".encode()
                held.write(squeeze.compress(data) if gzip else data)
        if name is not None:
            done.append(write(name, held.getvalue() + (squeeze.flush() if gzip else b"")))
        yield pa.RecordBatch.from_pydict({"path": pa.array(done, pa.string())})

    dealt = text.repartition("file").sortWithinPartitions("file", "place").select("file", "line")
    return sorted(r.path for r in dealt.mapInArrow(work, "path STRING").collect())  # a row for each archive
