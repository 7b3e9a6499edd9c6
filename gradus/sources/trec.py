"""Readers of the text formats: run files, judgment files, query files, JSON lines and corpus shards.

Lines are parsed in place, split by split. Only if a check fails are the files at fault read whole, for line numbers.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradus import schemas
from gradus.functions.strings import blank, finite, whole_number, words
from gradus.operators.validate import InvalidData, duplicates, outside, require_empty
from gradus.sources import archives, chunks, tables

# How run files end, how passage ids begin and are built (shard, byte offset), what ends a line of a string.
RUN_SUFFIXES = (".gz", ".txt", ".trec", ".run")
PREFIX = "msmarco_passage_"
PASSAGE_ID = r"^msmarco_passage_([0-9]+)_([0-9]+)\z"
SHARD_NAME = re.compile(r"msmarco_passage_([0-9]+)(?:\.gz)?")
FILE_BREAKS = "\r\n|\n|\r"
STRING_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def suffix(name: Column) -> Column:
    """Of a file's name, with its point; empty if it has none."""
    return F.regexp_extract(name, r"[^/](\.[^./]*)\z", 1)


def run_files(names: DataFrame) -> DataFrame:
    """``names`` (path) to path and run (the file's name) of those that are run files, in order."""
    run = F.element_at(F.split("path", "/"), -1)
    return names.where(suffix(F.col("path")).isin(*RUN_SUFFIXES)).select("path", run.alias("run")).orderBy("path")


def run_paths(folder: str) -> list[str]:
    """Run files of a folder in any file system that Spark lists, by path; folders inside it are left out."""
    files = SparkSession.active().read.format("binaryFile").option("recursiveFileLookup", False).load(folder)
    return [r.path for r in run_files(files.select("path")).collect()]


def cached_runs(spark: SparkSession, folder: str, names: Iterable[str], fetch: Callable[[str], Iterable[bytes]]) -> list[str]:
    """The named run files in a folder that executors see, fetched there if they are missing; all are checked, and manifest.json says what they hold."""
    paths = sorted(tables.cached_files(spark, folder, [*names], fetch, lambda p: read_runs(spark, [p])))
    tables.save_json(f"{folder}/manifest.json", tables.manifest(spark, paths))
    return paths


def parse_run_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (…, line) to the columns beside line, query_id, passage_id, score, and problem: null if the line is fine.

    Blank lines are left out. Six fields; the passage id has its prefix; the rank is a whole number, 0 or more, and not
    used further; the score is finite.
    """
    f = words(F.col("line"))
    rest = [c for c in lines.columns if c != "line"]
    rows = lines.where(~blank(F.col("line"))).select(*rest, "line", f.alias("f"))
    size, at = F.size("f"), lambda i: F.try_element_at("f", F.lit(i))
    problem = (
        F.when(size != 6, F.lit("expected six columns"))
        .when(~at(3).startswith(PREFIX) | F.coalesce(whole_number(at(4)) < 0, F.lit(True)), F.lit("invalid passage or rank"))
        .when(finite(at(5)).isNull(), F.lit("invalid score"))
    )
    return rows.select(*rest, "line", at(1).alias("query_id"), at(3).alias("passage_id"), finite(at(5)).alias("score"), problem.alias("problem"))


def parse_qrel_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (…, line) to query_id, passage_id, relevance and problem, beside the other columns. The second field is ignored."""
    rest = [c for c in lines.columns if c != "line"]
    rows = lines.where(~blank(F.col("line"))).select(*rest, "line", words(F.col("line")).alias("f"))
    at = lambda i: F.try_element_at("f", F.lit(i))
    grade = whole_number(at(4))
    problem = F.when(F.size("f") != 4, F.lit("expected four columns")).when(F.coalesce(~grade.isin(*schemas.GRADES), F.lit(True)) | ~at(3).rlike(PASSAGE_ID), F.lit("invalid judgment"))
    return rows.select(*rest, "line", at(1).alias("query_id"), at(3).alias("passage_id"), grade.alias("relevance"), problem.alias("problem"))


def parse_query_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (…, line) to query_id, text and problem, beside the other columns: split at the first tab, neither part empty."""
    rest = [c for c in lines.columns if c != "line"]
    part = lambda i: F.try_element_at(F.split("line", "\t", 2), F.lit(i))
    problem = F.when(part(2).isNull(), F.lit("no tab")).when((part(1) == "") | (part(2) == ""), F.lit("nothing on one side of the tab"))
    return lines.where(~blank(F.col("line"))).select(*rest, "line", part(1).alias("query_id"), part(2).alias("text"), problem.alias("problem"))


def parse_judgment_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (…, line) to the fields of a judgment and problem, beside the other columns.

    The schema is strict: a grade written as 1.0, true or "1" is no whole number.
    """
    rest = [c for c in lines.columns if c != "line"]
    parsed = F.from_json("line", f"{schemas.JUDGMENTS}, _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.where(~blank(F.col("line"))).select(*rest, parsed.alias("j")).select(*rest, "j.*")
    return rows.withColumn("problem", F.when(F.col("_bad").isNotNull(), F.lit("not of the schema"))).withColumnRenamed("_bad", "line")


def _fail(spark: SparkSession, bad: DataFrame, paths: list[str], breaks: str = FILE_BREAKS) -> None:
    """Raise with file and line number of the first lines at fault, if there are any."""
    some = {(r["run"], r["line"]): r["problem"] for r in bad.select("run", "line", "problem").limit(5).collect()}
    if not some:
        return
    named = {os.path.basename(p): p for p in paths}
    whole = spark.read.text([named[run] for run in {run for run, _ in some}], wholetext=True).select(F.col("_metadata.file_name").alias("run"), F.posexplode(F.split(F.regexp_replace("value", "^\ufeff", ""), breaks)).alias("at", "line"))
    places = {(r["run"], r["line"]): r["at"] + 1 for r in whole.where(F.col("line").isin([line for _, line in some])).orderBy(F.desc("at")).collect()}
    raise InvalidData("; ".join(f"{named[run]}:{places.get((run, line), '?')}: {problem}" for (run, line), problem in some.items()))


def file_lines(spark: SparkSession, paths: list[str], breaks: str | None = None) -> DataFrame:
    """run (file name), seq, line, split by split; with ``breaks`` also parted where a string's lines end. A byte-order mark goes.

    seq rises along a file: a split's first byte, and lines of its task before this one.
    """
    place = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = spark.read.text(paths).select(F.col("_metadata.file_name").alias("run"), place.alias("seq"), F.col("value").alias("line"))
    return rows.select("run", "seq", F.explode(F.split("line", breaks)).alias("line")) if breaks else rows


def read_runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """run (file name), query_id, passage_id, score of all run files; any bad line, repeat or empty file raises."""
    names = [os.path.basename(p) for p in paths]
    if len(set(names)) != len(names):
        raise InvalidData(f"Run files of one name: {sorted({n for n in names if names.count(n) > 1})}")
    parsed = parse_run_lines(file_lines(spark, paths))
    _fail(spark, parsed.where("problem IS NOT NULL"), paths)
    runs = parsed.select("run", "query_id", "passage_id", "score")
    require_empty(duplicates(runs, "run", "query_id", "passage_id"), "Passages that a run ranks twice")
    found = {r[0] for r in runs.select("run").distinct().collect()}  # a row for each file
    if missing := sorted(set(names) - found):
        raise InvalidData(f"Run files without a line: {missing}")
    return runs


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_id, text of a query file; an id may only repeat with its text."""
    parsed = parse_query_lines(file_lines(spark, [path], STRING_BREAKS))
    _fail(spark, parsed.where("problem IS NOT NULL"), [path], STRING_BREAKS)
    rows = parsed.select("query_id", "text").distinct()
    require_empty(duplicates(rows, "query_id"), "Queries of one id but several texts")
    return rows


def read_qrels(spark: SparkSession, path: str, queries: DataFrame, *, order: bool = False) -> DataFrame:
    """query_id, passage_id, relevance of a judgment file, checked against its queries; with ``order`` also seq, which rises line by line."""
    parsed = parse_qrel_lines(file_lines(spark, [path], STRING_BREAKS))
    _fail(spark, parsed.where("problem IS NOT NULL"), [path], STRING_BREAKS)
    rows = parsed.select("query_id", "passage_id", "relevance", *["seq"] * order)
    require_empty(duplicates(rows, "query_id", "passage_id"), "Pairs that are judged twice")
    require_empty(unknown_queries(rows, queries), "Judged queries that the query file lacks")
    if rows.isEmpty():
        raise InvalidData("The judgment file has no line")
    return rows


def unknown_queries(qrels: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id of judged queries that don't exist."""
    return outside(qrels, queries, "query_id").select("query_id").distinct()


def missing_passages(required: DataFrame, found: DataFrame) -> DataFrame:
    """passage_id of required passages that weren't found."""
    return outside(required, found, "passage_id").select("passage_id").distinct()


def shard_paths(paths: list[str], required: DataFrame) -> list[str]:
    """Of corpus shards, named by their number, those that a required passage is in; files of other names count as all numbers."""
    wanted = {r[0] for r in required.select(F.regexp_extract("passage_id", PASSAGE_ID, 1)).distinct().collect()}  # a row for each shard
    number = {p: os.path.basename(p).split(".")[0].removeprefix(PREFIX) for p in paths}
    return [p for p in paths if not number[p].isdigit() or number[p] in wanted]


def with_offsets(lines: DataFrame) -> DataFrame:
    """``lines`` (run, seq, line) with offset: the bytes of the file before each line, uncompressed.

    Lengths alone are sorted and summed, file by file; a line ends with one byte.
    """
    before = W.partitionBy("run").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    sized = lines.select("run", "seq", (F.octet_length("line") + 1).cast("bigint").alias("_size"))
    return lines.join(sized.select("run", "seq", F.coalesce(F.sum("_size").over(before), F.lit(0).cast("bigint")).alias("offset")), ["run", "seq"])


def parse_corpus_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (…, line) of JSON to passage_id, text, document_id, spans, beside the other columns."""
    rest = [c for c in lines.columns if c != "line"]
    rows = lines.select(*rest, F.from_json("line", schemas.CORPUS).alias("p"))
    return rows.select(*rest, F.col("p.pid").alias("passage_id"), F.col("p.passage").alias("text"), F.col("p.docid").alias("document_id"), "p.spans")


def misplaced(passages: DataFrame) -> DataFrame:
    """Of passages (run, offset, passage_id), those whose id isn't that of their shard and place in it."""
    part = lambda i: F.regexp_extract("passage_id", PASSAGE_ID, i)
    shard = F.regexp_extract("run", r"^(?:msmarco_passage_)?([0-9]+)(?:\..*)?\z", 1)
    return passages.where((part(2).try_cast("bigint").isNull()) | (part(2).try_cast("bigint") != F.col("offset")) | ((shard != "") & (shard != part(1))))


def corpus_lines(spark: SparkSession, paths: list[str], required: DataFrame | None = None) -> DataFrame:
    """run, offset (null where only a whole file's order gives it), line of shards in files and of those in tar archives.

    With ``required`` only members that its ids name are planned, and of an archive no byte but its headers and theirs is read.
    """
    tars = [p for p in paths if p.endswith(".tar")]
    parts = [archives.tar_lines(spark, p, None if required is None else [x.run for x in own_shards(archives.places(p), required)]) for p in tars]
    if plain := [p for p in paths if not p.endswith(".tar")]:
        parts.append(file_lines(spark, plain).select("run", F.lit(None).cast("bigint").alias("offset"), "line"))
    return reduce(DataFrame.unionByName, parts)


def own_shards(shards: list[archives.Place], required: DataFrame) -> list[archives.Place]:
    """Of an archive's members the shards that a required passage is in, by the number in their names; other files are none."""
    kept = set(shard_paths([s.run for s in shards], required))
    return [s for s in shards if s.run in kept and shard_number(s.run) is not None]


def shard_number(run: str) -> str | None:
    """The number in a shard's name; None for other files."""
    named = SHARD_NAME.fullmatch(run)
    return named and named[1]


def passages_at(required: DataFrame, paths: list[str]) -> DataFrame:
    """passage_id, run, offset, text, document_id, spans and bytes of the required passages, by the places that their ids say.

    Shards that aren't compressed, also inside tar archives, are read by seeking, others as far as needed. An id at whose place
    no passage of that id stands has no text; one of no shard is left out.
    """
    shards = [(shard_number(s.run), s) for p in paths for s in archives.places(p)]
    part = lambda i: F.regexp_extract("passage_id", PASSAGE_ID, i)
    spark = required.sparkSession
    names = spark.createDataFrame([(n, s.run) for n, s in shards if n is not None], "_shard STRING, run STRING")
    wanted = required.select("passage_id", part(1).alias("_shard"), part(2).try_cast("bigint").alias("offset")).distinct().where("offset IS NOT NULL")
    found = archives.lines_at(wanted.join(names, "_shard").select("run", "offset", "passage_id"), [s for n, s in shards if n is not None])
    p = F.from_json("line", schemas.CORPUS)
    right = F.col("p.pid") == F.col("passage_id")
    return found.withColumn("p", p).select("passage_id", "run", "offset", *[F.when(right, F.col(f"p.{a}")).alias(b) for a, b in (("passage", "text"), ("docid", "document_id"), ("spans", "spans"))], "bytes")


def read_corpus(spark: SparkSession, paths: list[str], required: DataFrame, *, check_offsets: bool = False, seek: bool = False) -> DataFrame:
    """The required passages of JSON-line shards (gzip, plain, or members of tar archives); a missing or malformed one raises.

    Only shards that the required ids name are read. With ``check_offsets`` an id must also say at which byte of which
    shard it stands; with ``seek`` passages are looked up there, and no shard is scanned. The optimizer broadcasts the
    required ids only under its own size threshold; else both sides are shuffled.
    """
    wanted = required.select("passage_id").distinct()
    if seek:
        found = passages_at(required, paths)
        require_empty(found.where("text IS NULL AND document_id IS NULL AND spans IS NULL").select("passage_id", "run", "offset"), "Passages at another place than their id says")
        rows = found.select("passage_id", "text", "document_id", "spans")
    else:
        own = [p for p in paths if p.endswith(".tar")] + shard_paths([p for p in paths if not p.endswith(".tar")], required)
        if not own:
            require_empty(wanted.orderBy("passage_id"), "Passages that no shard has")
        if check_offsets:
            tars, plain = [p for p in own if p.endswith(".tar")], [p for p in own if not p.endswith(".tar")]
            parts = [corpus_lines(spark, tars, required)] if tars else []
            lines = reduce(DataFrame.unionByName, [*parts, *[with_offsets(file_lines(spark, plain)).select("run", "offset", "line")] * bool(plain)])
        else:
            lines = corpus_lines(spark, own or paths, required)
        found = parse_corpus_lines(lines).join(wanted, "passage_id", "left_semi")
        if check_offsets:
            require_empty(misplaced(found).select("passage_id", "run", "offset"), "Passages at another place than their id says")
        rows = found.select("passage_id", "text", "document_id", "spans")
    require_empty(rows.where("text IS NULL OR document_id IS NULL OR spans IS NULL").select("passage_id"), "Passages that lack a field")
    require_empty(missing_passages(required, rows).orderBy("passage_id"), "Passages that no shard has")
    return rows.dropDuplicates(["passage_id"])


#: How a checkpoint's chunks are parted: judgments, pairs that failed, pairs that are to be asked again.
DONE, FAILED, LATER = 0, 1, 2


def checkpoint_lines(spark: SparkSession, path: str, kind: int) -> DataFrame | None:
    """The lines (value, chunk) of one kind that a checkpoint's chunks hold; of other files and folders all lines are judgments."""
    lines = chunks.read_text(spark, path, "failed INT")
    if lines is not None:
        return lines.where(F.col("failed") == kind).select("value", "chunk")
    if kind != DONE or not tables.exists(path) or tables.exists(f"{path}/data"):
        return None
    return spark.read.text(path).select("value", F.lit(None).cast("string").alias("chunk"))


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """The checkpoint of a judging run; none yet gives an empty table, a line of other shape raises."""
    lines = checkpoint_lines(spark, path, DONE)
    if lines is None:
        return spark.createDataFrame([], schemas.JUDGMENTS)
    rows = parse_judgment_lines(lines.select(F.col("value").alias("line")))
    require_empty(rows.where("problem IS NOT NULL").select("line"), "Lines that are no judgment")
    return rows.drop("line", "problem")


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """query_id, passage_id, error, type and chunk of the pairs that failed, from the same checkpoint."""
    lines = checkpoint_lines(spark, path, FAILED)
    if lines is None:
        return spark.createDataFrame([], f"{schemas.FAILURES}, chunk STRING")
    return lines.select(F.from_json("value", schemas.FAILURES).alias("f"), "chunk").select("f.*", "chunk")


def read_deferred(spark: SparkSession, path: str) -> DataFrame:
    """query_id, passage_id, attempt, not_before and chunk of the pairs that were put off, from the same checkpoint."""
    lines = checkpoint_lines(spark, path, LATER)
    schema = "query_id STRING, passage_id STRING, attempt INT, not_before DOUBLE"
    if lines is None:
        return spark.createDataFrame([], f"{schema}, chunk STRING")
    return lines.select(F.from_json("value", schema).alias("f"), "chunk").select("f.*", "chunk")
