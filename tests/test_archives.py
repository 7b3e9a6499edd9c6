"""Shards inside tar archives, and passages by the byte at which they stand."""

from __future__ import annotations

import gzip
import io
import json
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from gradus.operators.validate import InvalidData
from gradus.sources import archives, trec


def shard(number, n, seed=0, long=()):
    """Bytes of a shard, and its ids with their texts."""
    rng, out, texts = random.Random(seed), b"", {}
    for i in range(n):
        pid = f"msmarco_passage_{number}_{len(out)}"
        texts[pid] = "é" * (200_000 if i in long else rng.randrange(60)) + str(i)
        out += json.dumps({"pid": pid, "passage": texts[pid], "docid": "D", "spans": "()"}, ensure_ascii=False).encode() + b"\n"
    return out, texts


def tar(path, members):
    with tarfile.open(path, "w") as out:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            out.addfile(info, io.BytesIO(data))
        folder = tarfile.TarInfo("corpus/empty")
        folder.type = tarfile.DIRTYPE
        out.addfile(folder)
    return str(path)


def ids(spark, names):
    return spark.createDataFrame([(x,) for x in names], "passage_id string")


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    one, two, three = shard("01", 300, 1), shard("02", 300, 2, long=(7, 8, 150)), shard("03", 5, 3)
    path = tar(folder / "c.tar", [("x/README", b"no shard\n"), ("x/msmarco_passage_01.gz", gzip.compress(one[0])), ("x/" + "deep/" * 40 + "msmarco_passage_02", two[0]), ("x/msmarco_passage_03.gz", gzip.compress(three[0][:100]) + gzip.compress(three[0][100:]))])
    return path, {"01": one, "02": two, "03": three}


def test_lines(spark, corpus, monkeypatch):
    path, shards = corpus
    rows = archives.tar_lines(spark, path, ["msmarco_passage_01.gz", "msmarco_passage_02", "msmarco_passage_03.gz"]).collect()
    for number, (data, _) in shards.items():
        own = sorted((r.offset, r.line) for r in rows if r.run.startswith(f"msmarco_passage_{number}"))
        assert "".join(line + "\n" for _, line in own).encode() == data and all(data[at:].startswith(line.encode()) for at, line in own)
    assert {r.run for r in archives.tar_lines(spark, path).collect()} == {"README", *(r.run for r in rows)}


def test_parts_of_a_shard(corpus, monkeypatch):
    """Every line is in the part in which it begins, whatever the parts' size, also if a part begins with a line."""
    path, shards = corpus
    for split in (50, 97, 1000, 400_000):
        monkeypatch.setattr(archives, "SPLIT", split)
        reader = archives.TarReader(path, ["msmarco_passage_02"])
        got = [(a, x) for part in reader.partitions() for b in reader.read(part) for a, x in zip(b["offset"].to_pylist(), b["line"].to_pylist(), strict=True)]
        assert "".join(x + "\n" for _, x in got).encode() == shards["02"][0]


def test_only_named_members_are_planned(spark, corpus):
    path, _ = corpus
    assert archives.tar_lines(spark, path, []).count() == 0
    rows = archives.tar_lines(spark, path, ["msmarco_passage_03.gz"])
    assert rows.rdd.getNumPartitions() == 1 and rows.count() == 5
    own = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for condition in (F.col("run") == "msmarco_passage_03.gz", F.col("run").isin("msmarco_passage_03.gz", "none")):
            some = archives.tar_lines(spark, path).where(condition & F.col("line").isNotNull())
            assert some.count() == 5 and some.rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", own)


@pytest.mark.parametrize("seek", [False, True])
def test_read_corpus(spark, corpus, seek):
    path, shards = corpus
    texts = {**shards["01"][1], **shards["02"][1]}
    wanted = [*texts][::3] + [*texts][:2]
    got = trec.read_corpus(spark, [path], ids(spark, wanted), check_offsets=True, seek=seek)
    assert {r.passage_id: r.text for r in got.collect()} == {p: texts[p] for p in wanted} and got.count() == len(set(wanted))
    first = [*shards["01"][1]][0]
    for wrong, message in (("msmarco_passage_04_0", "no shard has"), (f"msmarco_passage_01_{10**9}", "another place" if seek else "no shard has"), (first + "1", "another place" if seek else "no shard has"), ("junk", "no shard has")):
        with pytest.raises(InvalidData, match=message):
            trec.read_corpus(spark, [path], ids(spark, [first, wrong]), check_offsets=True, seek=seek)


def test_seeking_reads_what_is_wanted(spark, tmp_path):
    data, texts = shard("07", 20_000, 4)
    (tmp_path / "msmarco_passage_07").write_bytes(data)
    names = [*texts]
    some = names[100:103] + names[5000:5001] + names[19_999:]
    rows = trec.passages_at(ids(spark, some), [str(tmp_path / "msmarco_passage_07")]).collect()
    assert {r.passage_id: r.text for r in rows} == {p: texts[p] for p in some}
    read = sum(r.bytes for r in rows)
    assert read < 3 * 2 * archives.GUESS < len(data) / 50
    every = trec.passages_at(ids(spark, names), [str(tmp_path / "msmarco_passage_07")])
    assert {r.passage_id: r.text for r in every.collect()} == texts  # the same rows as a scan
    assert every.agg(F.sum("bytes")).first()[0] < 1.2 * len(data)


def test_a_compressed_shard_is_read_once(spark, tmp_path):
    data, texts = shard("08", 15_000, 5)  # more offsets than one Arrow batch takes
    (tmp_path / "msmarco_passage_08.gz").write_bytes(gzip.compress(data))
    rows = trec.passages_at(ids(spark, [*texts]), [str(tmp_path / "msmarco_passage_08.gz")]).collect()
    assert {r.passage_id: r.text for r in rows} == texts and sum(r.bytes for r in rows) == len(data)
    part = trec.passages_at(ids(spark, [*texts][:10]), [str(tmp_path / "msmarco_passage_08.gz")]).collect()
    assert sum(r.bytes for r in part) <= len(data)


def test_damaged_archives(spark, tmp_path, corpus):
    path, shards = corpus
    whole = open(path, "rb").read()
    for cut in (700, 1500, 5000):
        (tmp_path / f"{cut}.tar").write_bytes(whole[:cut])
        with pytest.raises(ValueError):
            archives.places(str(tmp_path / f"{cut}.tar"))
    squeezed = gzip.compress(shards["01"][0])
    bad = tar(tmp_path / "bad.tar", [("msmarco_passage_01.gz", squeezed[:-20])])
    with pytest.raises(Exception, match="end early"):
        archives.tar_lines(spark, bad).count()
    broken = tar(tmp_path / "utf.tar", [("msmarco_passage_01", b"\xff\xfe\n")])
    with pytest.raises(Exception, match="(?i)utf"):
        archives.tar_lines(spark, broken).collect()
    assert archives.tar_lines(spark, tar(tmp_path / "none.tar", [("msmarco_passage_01", b"")])).collect() == []


def test_pack(spark, tmp_path):
    text = spark.createDataFrame([(f"msmarco_passage_0{i % 2}", i, f"line {i} é") for i in range(50)], "file string, place int, line string")
    for packed in (True, False):
        paths = archives.pack(text, str(tmp_path / str(packed)), gzip=packed)
        assert [p.rsplit("/", 1)[1] for p in paths] == ["msmarco_passage_00.tar", "msmarco_passage_01.tar"]
        rows = trec.corpus_lines(spark, paths).where("run <> 'README'").collect()
        assert sorted(r.line for r in rows) == sorted(f"line {i} é" for i in range(50))
