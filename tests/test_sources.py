"""Readers, checks and the building of a collection."""

from __future__ import annotations

import gzip
import json

import pytest

from gradus.functions.strings import finite, whole_number, words
from gradus.operators import collection, validate
from gradus.operators.validate import InvalidData
from gradus.sources import tables, trec
from pyspark.sql import functions as F

P = "msmarco_passage_00_"


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_runs(spark, tmp_path):
    write(tmp_path / "a.run", f"1 Q0 {P}1 0 2.5 t\n\n 1\tQ0 {P}2 1 1e-3 t\r\n")
    with gzip.open(tmp_path / "b.gz", "wt") as out:
        out.write(f"1 Q0 {P}1 0 2 t\n")
    (tmp_path / "notes.md").write_text("no run")
    paths = trec.run_paths(str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["a.run", "b.gz"]
    rows = {tuple(r) for r in trec.read_runs(spark, paths).collect()}
    assert rows == {("a.run", "1", P + "1", 2.5), ("a.run", "1", P + "2", 0.001), ("b.gz", "1", P + "1", 2.0)}


@pytest.mark.parametrize(
    "line", [f"1 Q0 {P}1 1 0.5", "1 Q0 doc 1 0.5 x", f"1 Q0 {P}1 -1 0.5 x", f"1 Q0 {P}1 1 nan x", f"1 Q0 {P}1 1 inf x", f"1 Q0 {P}1 1 1.0d x", f"1 Q0 {P}1 one 1 x"]
)
def test_bad_run_lines(spark, tmp_path, line):
    path = write(tmp_path / "a.run", f"1 Q0 {P}7 0 2.5 t\n{line}\n")
    with pytest.raises(InvalidData, match="a.run:2"):
        trec.read_runs(spark, [path])


def test_bad_runs(spark, tmp_path):
    twice = write(tmp_path / "a.run", f"1 Q0 {P}7 0 2 t\n1 Q0 {P}7 1 1 t\n")
    with pytest.raises(InvalidData, match="ranks twice"):
        trec.read_runs(spark, [twice])
    with pytest.raises(InvalidData, match="without a line"):
        trec.read_runs(spark, [write(tmp_path / "b.run", "\n  \n")])
    with pytest.raises(InvalidData, match="of one name"):
        trec.read_runs(spark, [twice, twice])


def build(spark, tmp_path, queries="﻿1\tone two\n2\ttwo\tmore\n1\tone two\n9\tunjudged\n", qrels=f"1 0 {P}5 3\n2 0 {P}6 0\n", corpus=(5, 6, 7)):
    q, r = write(tmp_path / "q.tsv", queries), write(tmp_path / "qrels.txt", qrels)
    with gzip.open(tmp_path / "shard.gz", "wt") as out:
        for d in corpus:
            out.write(json.dumps({"pid": P + str(d), "passage": f"text {d}", "docid": "D", "spans": "(0,1)"}) + "\n")
    return collection.build(spark, q, r, [str(tmp_path / "shard.gz")])


def test_build_and_summarize(spark, tmp_path):
    made = build(spark, tmp_path)
    tables.write_collection(made, str(tmp_path / "out"))
    tables.write_collection(made, str(tmp_path / "out"))
    got = tables.read_collection(spark, str(tmp_path / "out"))
    assert [tuple(r) for r in got["queries"].orderBy("query_id").collect()] == [("1", "one two"), ("2", "two\tmore")]
    s = collection.summarize(**got)
    assert s["number_of_passages"] == 2 and s["relevance_grades"]["3"] == {"number_of_judgments": 1, "average_judged_passages_per_query": 0.5}
    assert "Number of judgments: 2" in collection.as_text(s)


@pytest.mark.parametrize(
    "change, message",
    [
        ({"queries": "1 no tab\n"}, "q.tsv:1: no tab"), ({"queries": "\ttext\n"}, "q.tsv:1: nothing on one side"), ({"queries": "1\ta\n1\tb\n"}, "several texts"),
        ({"qrels": f"1 0 {P}5\n"}, "qrels.txt:1"), ({"qrels": f"1 0 {P}5 4\n"}, "qrels.txt:1"), ({"qrels": f"1 0 {P}6 1\n1 0 {P}5 x\n"}, "qrels.txt:2"), ({"qrels": f"1 0 msmarco_passage_5 1\n"}, "qrels.txt:1"),
        ({"qrels": f"1 0 {P}5 1\n1 0 {P}5 1\n"}, "judged twice"), ({"qrels": f"7 0 {P}5 1\n"}, "query file lacks"), ({"qrels": "\n"}, "has no line"), ({"corpus": (5,)}, "no shard has"),
    ],
)
def test_faulty_collections(spark, tmp_path, change, message):
    with pytest.raises(InvalidData, match=message):
        build(spark, tmp_path, **change)


def test_collection_checks(spark):
    q = spark.createDataFrame([("1", "x"), ("2", "y")], "query_id string, text string")
    p = spark.createDataFrame([("a", "t")], "passage_id string, text string")
    r = spark.createDataFrame([("1", "a", 1)], "query_id string, passage_id string, relevance int")
    validate.check_collection(q, p, r, all_judged=False)
    with pytest.raises(InvalidData, match="never judged"):
        validate.check_collection(q, p, r)
    with pytest.raises(InvalidData, match="query id repeats"):
        validate.check_collection(q.union(q), p, r, all_judged=False)
    with pytest.raises(InvalidData, match="grade"):
        validate.check_collection(q, p, r.withColumn("relevance", F.lit(None).cast("int")), all_judged=False)
    with pytest.raises(InvalidData, match="no query"):
        validate.check_collection(q.limit(0), p.limit(0), r.limit(0), all_judged=False)
    with pytest.raises(InvalidData, match="Schemas differ"):
        validate.check_equal(q, p)
    with pytest.raises(InvalidData, match="first"):
        validate.check_equal(q.union(q), q)


@pytest.mark.parametrize("grade", ["1.0", "true", '"1"', "null", "7"])
def test_strict_grades(spark, tmp_path, grade):
    path = write(tmp_path / "j.json", '{"query_id": "1", "passage_id": "a", "human_relevance": 1, "predicted_relevance": %s}\n' % grade)
    with pytest.raises(InvalidData):
        validate.check_judgments(trec.read_judgments(spark, path))


def test_missing_checkpoint_is_empty(spark, tmp_path):
    assert trec.read_judgments(spark, str(tmp_path / "none")).count() == 0


def test_strings(spark):
    rows = spark.createDataFrame([("a b  c", 3), ("", 0), ("  x\x85y", 2)], "t string, n int")
    assert rows.where(F.size(words(F.col("t"))) != F.col("n")).count() == 0
    numbers = spark.createDataFrame([("1.5", 1.5, None), ("+2", 2.0, 2), ("-3", -3.0, -3), ("1e3", 1000.0, None), ("1.0d", None, None), ("0x1p3", None, None), ("nan", None, None), ("1_0", None, None), ("1e999", None, None)], "t string, f double, i int")
    assert numbers.where(~finite(F.col("t")).eqNullSafe(F.col("f")) | ~whole_number(F.col("t")).eqNullSafe(F.col("i"))).count() == 0


def test_json_documents(spark, tmp_path):
    path = str(tmp_path / "deep/er/x.json")
    for value in ({"a": 1}, {"b": "é"}):
        tables.save_json(path, value)
        assert tables.load_json(path) == value and json.load(open(path)) == value
    tables.remove(path)
    assert not tables.exists(path) and tables.load_json(path) == {}


def shard(tmp_path, name, texts, shift=0):
    """A gzip shard whose ids say where they stand."""
    at, number = 0, name.split("_")[2].split(".")[0]
    with gzip.open(tmp_path / name, "wt", encoding="utf-8", newline="") as out:
        ids = []
        for text in texts:
            ids.append(f"msmarco_passage_{number}_{at + shift:08}")
            line = json.dumps({"pid": ids[-1], "passage": text, "docid": "D", "spans": "()"}, ensure_ascii=False) + "\n"
            out.write(line)
            at += len(line.encode())
    return ids


def test_shards_and_offsets(spark, tmp_path):
    one, two = shard(tmp_path, "msmarco_passage_01.gz", ["a", "bé", "c"]), shard(tmp_path, "msmarco_passage_02.gz", ["d", "e"], shift=1)
    paths = [str(tmp_path / n) for n in ("msmarco_passage_01.gz", "msmarco_passage_02.gz")]
    wanted = lambda ids: spark.createDataFrame([(i,) for i in ids], "passage_id string")
    assert trec.shard_paths(paths, wanted(one[:1])) == paths[:1]
    got = trec.read_corpus(spark, paths, wanted(one[1:]), check_offsets=True)
    assert sorted(tuple(r)[:2] for r in got.collect()) == list(zip(one[1:], ["bé", "c"]))
    with pytest.raises(InvalidData, match="another place"):
        trec.read_corpus(spark, paths, wanted(two[1:]), check_offsets=True)
    assert trec.read_corpus(spark, paths, wanted(two)).count() == 2
    with pytest.raises(InvalidData, match="no shard has"):
        trec.read_corpus(spark, paths, wanted(["msmarco_passage_07_1"]))


def test_passages_are_kept_by_the_judgments_digest(spark, tmp_path):
    cache = str(tmp_path / "cache")
    q, r = write(tmp_path / "q.tsv", "1\tone\n"), write(tmp_path / "r.txt", f"1 0 {P}5 3\n")
    corpus = tmp_path / "s.json"
    line = lambda d: json.dumps({"pid": P + str(d), "passage": f"text {d}", "docid": "D", "spans": ""}) + "\n"
    corpus.write_text(line(5) + line(6))
    for _ in range(2):
        assert collection.build(spark, q, r, [str(corpus)], cache=cache)["passages"].count() == 1
        corpus.write_text("")  # a second build doesn't read it
    write(tmp_path / "r.txt", f"1 0 {P}6 3\n")
    with pytest.raises(InvalidData, match="no shard has"):
        collection.build(spark, q, r, [str(corpus)], cache=cache)


def test_cached_runs(spark, tmp_path):
    good, bad = f"1 Q0 {P}1 0 2.5 t\n".encode(), b"nothing of a run\n"
    asked = str(tmp_path / "asked")

    def fetch(name):  # on an executor
        with open(asked, "a") as out:
            out.write(f"{name}\n")
        yield good[:7] if name != "bad.run" else bad
        if name == "cut.run":
            raise OSError("cut")
        yield good[7:] if name != "bad.run" else b""

    folder = str(tmp_path / "runs")
    for _ in range(2):
        assert [p.rsplit("/", 1)[1] for p in trec.cached_runs(spark, folder, ["b.run", "a.run"], fetch)] == ["a.run", "b.run"]
    assert sorted(open(asked).read().split()) == ["a.run", "b.run"] and [r["file"] for r in tables.load_json(f"{folder}/manifest.json")] == ["a.run", "b.run"]
    with pytest.raises(InvalidData):
        trec.cached_runs(spark, folder, ["bad.run"], fetch)
    with pytest.raises(Exception, match="cut"):
        trec.cached_runs(spark, folder, ["cut.run"], fetch)
    assert sorted(p.name for p in (tmp_path / "runs").iterdir() if not p.name.startswith(".")) == ["a.run", "b.run", "manifest.json"]
    (tmp_path / "runs/a.run").write_bytes(bad)
    with pytest.raises(InvalidData):
        trec.cached_runs(spark, folder, ["a.run"], fetch)


def test_revisions(spark, tmp_path):
    made = {"queries": spark.createDataFrame([("1", "a")], "query_id string, text string"), "passages": spark.createDataFrame([("p", "t")], "passage_id string, text string"), "qrels": spark.createDataFrame([("1", "p", 1)], "query_id string, passage_id string, relevance int")}
    for revision, text in (("r1", "a"), ("r2", "b")):
        tables.write_collection({**made, "queries": made["queries"].withColumn("text", F.lit(text))}, str(tmp_path), revision)
    assert [tables.read_collection(spark, str(tmp_path), r)["queries"].first().text for r in ("r1", "r2")] == ["a", "b"]
    with pytest.raises(InvalidData):  # what is published stays
        tables.write_collection({**made, "queries": made["queries"].withColumn("text", F.lit("c"))}, str(tmp_path), "r1")


def test_json_sink_refuses_nan(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.save_json(str(tmp_path / "x.json"), {"a": float("nan")})
    assert tables.load_json(str(tmp_path / "x.json")) == {}
