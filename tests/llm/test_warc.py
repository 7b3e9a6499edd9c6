"""Archives against plain Python: digests, revisits, exact round trips and damage."""

from __future__ import annotations

import base64
import glob
import gzip
import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gradus.llm import warc

SCHEMA = "page_id bigint, url string, payload binary, digest string, head string"  # the last two clash with the archive's own


def made(spark, rows, folder, **more):
    given = spark.createDataFrame([(*r, "mine", "mine") for r in rows], SCHEMA)
    warc.store(warc.records(given, **more), given, folder)
    return warc.restore(spark, folder)


def want(rows, least=0):
    out = []
    for i, (page, _, payload) in enumerate(rows):
        payload = payload or b""
        same = [(p is None, p or 0, u or "", j) for j, (p, u, x) in enumerate(rows) if (x or b"") == payload]
        first = len(payload) < least or min(same)[3] == i
        refers = None if first else rows[min(same)[3]][0]
        out.append((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if first else "revisit", refers))
    return sorted(out, key=str)


ROWS = [
    (5, "http://a/", b"same"), (3, "http://b/\r\nX-Evil: 1", b"same"), (9, None, b"same"), (9, None, b"same"), (None, "http://n/", b"same"), (1, "http://c/", b""), (2, "http://d/", None),
    (7, "http://e/", b"line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" + bytes(range(256))), (8, "u", b"x" * 3_000_000), (4, "u", "ü€".encode()), (None, None, b"alone"), (6, "z", b"r"), (6, "a", b"r"),
]


@pytest.mark.parametrize("least", [0, 2, 5])
def test_digests(spark, tmp_path, least):
    found = warc.digests(made(spark, ROWS, str(tmp_path / "a"), least=least))
    assert sorted(map(tuple, found.collect()), key=str) == want(ROWS, least)


def test_each_payload_once(spark, tmp_path):
    rows = [(i, f"u{i}", b"hot") for i in range(500)] + [(i + 1000, "v", b"%d" % i) for i in range(50)]
    found = warc.digests(made(spark, rows, str(tmp_path / "a"))).collect()
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 51
    assert sorted(map(tuple, found), key=str) == want(rows)


def test_no_rows(spark, tmp_path):
    assert warc.digests(made(spark, [], str(tmp_path / "a"))).collect() == []


def test_files_and_back(spark, tmp_path):
    """Records as files, the files as an archive, and the archive as the same bytes."""
    restored = made(spark, ROWS, str(tmp_path / "a")).coalesce(1)
    warc.write_files(restored, str(tmp_path / "files"))
    (path,) = glob.glob(str(tmp_path / "files/part-*"))
    data = open(path, "rb").read()
    records = list(warc.split_records(data))
    assert len(records) == len(ROWS) and b"".join(h + p + b"\r\n\r\n" for h, p in records) == data
    assert b"\r\nX-Evil" not in data and b"http://b/%0D%0AX-Evil: 1" in data
    with open(tmp_path / "members.warc.gz", "wb") as out:  # as crawlers write them: a member for each record
        out.writelines(gzip.compress(h + p + b"\r\n\r\n") for h, p in records)
    warc.archive_files(spark, str(tmp_path / "members.warc.gz"), str(tmp_path / "b"))
    again = warc.restore(spark, str(tmp_path / "b"))
    assert again.select("payload").distinct().count() == spark.read.parquet(str(tmp_path / "b/payloads")).count()
    warc.write_files(again.coalesce(1).sortWithinPartitions("file", "seq"), str(tmp_path / "out"))
    (path,) = glob.glob(str(tmp_path / "out/part-*"))
    assert open(path, "rb").read() == data


def test_foreign_records():
    info = b"WARC/1.0\r\nwarc-type: warcinfo\r\ncontent-length:  5 \r\nContent-Type: application/warc-fields\r\n\r\na: b\n\r\n\r\n"
    assert list(warc.split_records(info)) == [(info[:-9], b"a: b\n")]
    assert list(warc.split_records(b"")) == []
    for bad in (info[:-1], info[:-4], b"junk" + info, b"WARC/1.0\r\nWARC-Type: x\r\n\r\n\r\n\r\n", gzip.compress(info)[:-3]):
        with pytest.raises(ValueError):
            list(warc.split_records(bad))


def test_damage(spark, tmp_path):
    rows = [(1, "u", b"one"), (2, "u", b"two")]
    made(spark, rows, str(tmp_path / "a"))
    payloads = spark.read.parquet(str(tmp_path / "a/payloads"))
    heads = spark.read.parquet(str(tmp_path / "a/heads"))
    for name, bad in (("changed", payloads.withColumn("payload", F.concat("payload", F.lit(b"!")))), ("lost", payloads.limit(1))):
        bad.write.parquet(str(tmp_path / name / "payloads"))
        heads.write.parquet(str(tmp_path / name / "heads"))
        with pytest.raises(PySparkException, match="payload of digest"):
            warc.digests(warc.restore(spark, str(tmp_path / name))).collect()
