"""A judged collection and system runs derived from the test tables by whole-number rules, alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = "msmarco_passage_00_"
SYSTEMS, DEPTH, POOL = 35, 100, 60
ABSENT_SYSTEM, TWIN, UNJUDGED = 7, 34, 9999


def _grade(i: Column, d: Column) -> Column:
    h = (i * 31 + d * 17) % 100
    return F.when(h < 62, 0).when(h < 82, 1).when(h < 92, 2).otherwise(3)


class Fixtures:
    """The derived relations of one folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.folder = spark, sf_dir
        self.documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
        self.benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
        self.n = F.lit(self.documents.count())

    def queries(self) -> DataFrame:
        return self.benchmark.select(F.col("item_id").cast("string").alias("query_id"), "text")

    def passages(self) -> DataFrame:
        return self.documents.select(F.concat(F.lit(PREFIX), F.col("doc_id").cast("string")).alias("passage_id"), "text", F.col("source").alias("document_id"), F.col("lang").alias("spans"))

    def _pool(self) -> DataFrame:
        """i, d, relevance of each judged pair."""
        rows = self.benchmark.select(F.col("item_id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(POOL - 1))).alias("j"))
        rows = rows.select("i", ((F.col("i") * 101 + F.col("j") * 7) % self.n).alias("d"))
        return rows.withColumn("relevance", _grade(F.col("i"), F.col("d")))

    @staticmethod
    def _named(rows: DataFrame, *more: str) -> DataFrame:
        return rows.select(F.col("i").cast("string").alias("query_id"), F.concat(F.lit(PREFIX), F.col("d").cast("string")).alias("passage_id"), *more)

    def qrels(self) -> DataFrame:
        return self._named(self._pool(), "relevance")

    def judgments(self) -> DataFrame:
        """Pairs with both grades, usage and the probabilities of the grades."""
        i, d, rel = F.col("i"), F.col("d"), F.col("relevance")
        t = (i * 13 + d * 29) % 10
        predicted = F.when(t < 6, rel).when(t < 8, F.least(F.lit(3), rel + 1)).otherwise(F.greatest(F.lit(0), rel - 1))
        tokens = F.when(d % 19 != 0, F.struct((200 + d % 300).cast("bigint").alias("input_tokens"), F.when(d % 17 != 0, 1 + i % 5).cast("bigint").alias("output_tokens")))
        probabilities = F.array(*[((d * (g + 3) + i * 7) % 8).cast("double") / 8 for g in range(4)])
        return self._named(self._pool(), rel.alias("human_relevance"), predicted.alias("predicted_relevance"), tokens.alias("usage"), probabilities.alias("probabilities"), ((i + d) % 3 != 0).alias("done"))

    def graded(self) -> DataFrame:
        return self.judgments().select("query_id", "passage_id", F.col("human_relevance").alias("human"), F.col("predicted_relevance").alias("predicted"))

    def checkpoint(self) -> DataFrame:
        """Two thirds of the judgments, with stale human grades."""
        stale = ((F.col("human_relevance") + 1) % 4).cast("int").alias("human_relevance")
        return self.judgments().where("done").select("query_id", "passage_id", stale, "predicted_relevance")

    def runs(self) -> DataFrame:
        items = self.benchmark.select(F.col("item_id").alias("i")).unionByName(self.spark.range(1).select(F.lit(UNJUDGED).cast("bigint").alias("i")))
        rows = items.select("i", F.explode(F.sequence(F.lit(0), F.lit(SYSTEMS - 1))).alias("s")).withColumn("e", F.when(F.col("s") == TWIN, TWIN - 1).otherwise(F.col("s")))
        rows = rows.where(~((F.col("s") == ABSENT_SYSTEM) & (F.col("i") % 10 == 3))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(DEPTH - 1))))
        i, e, d = F.col("i"), F.col("e"), F.col("d")
        rows = rows.withColumn("d", (i * 101 + (F.col("j") + e % 5) * 7) % self.n)
        score = ((d * (2 * e + 3) * 37 + i * 11) % 64 + e * _grade(i, d)).cast("double") / F.lit(64.0)
        name = F.when(i == UNJUDGED, F.lit("unjudged")).otherwise(i.cast("string"))
        return rows.select(F.concat(F.lit("s"), F.lpad(F.col("s").cast("string"), 2, "0")).alias("run"), name.alias("query_id"), F.concat(F.lit(PREFIX), d.cast("string")).alias("passage_id"), score.alias("score"))

    def dirty(self) -> DataFrame:
        """The qrels with a repeated pair, two grades outside the domain, an unknown query and an unknown passage."""
        bad = self.spark.createDataFrame([("0", PREFIX + "0", 4), ("1", PREFIX + "1", -1), ("nobody", PREFIX + "2", 1), ("2", PREFIX + "missing", 2), ("3", PREFIX + "3", 0), ("3", PREFIX + "3", 0)], "query_id string, passage_id string, relevance int")
        return self.qrels().unionByName(bad)

    def run_lines(self) -> DataFrame:
        """Every system's rows as text, with lines of every kind of fault."""
        good = self.runs().select("run", F.concat_ws(" ", "query_id", F.lit("Q0"), "passage_id", F.lit("1"), F.col("score").cast("decimal(12,6)").cast("string"), "run").alias("line"))
        return good.unionByName(self.spark.createDataFrame([("bad", x) for x in BAD_RUN_LINES], "run string, line string"))

    def file_names(self) -> DataFrame:
        """A path for each document, of a run file or not."""
        kinds = F.array(*[F.lit(x) for x in SUFFIXES])
        name = F.concat(F.lit("runs/"), "source", F.lit("/r"), F.col("doc_id").cast("string"), F.element_at(kinds, (F.col("doc_id") % len(SUFFIXES) + 1).cast("int")))
        return self.documents.select(name.alias("path"))

    def run_text(self) -> DataFrame:
        """file, place, line: the rows of all systems as run files."""
        score = F.col("score").cast("decimal(12,6)").cast("string")
        line = F.concat_ws(" ", "query_id", F.lit("Q0"), "passage_id", F.lit("1"), score, "run")
        return self.runs().select(F.concat("run", F.lit(".run")).alias("file"), F.struct("query_id", "passage_id").alias("place"), line.alias("line"))

    def judgment_lines(self) -> DataFrame:
        good = self.judgments().select(F.to_json(F.struct("query_id", "passage_id", "human_relevance", "predicted_relevance", "usage")).alias("line"))
        return good.unionByName(self.spark.createDataFrame([(x,) for x in BAD_JUDGMENT_LINES], "line string"))

    def query_records(self) -> DataFrame:
        """Records of a query file, some of several lines by breaks that only strings know, some at fault."""
        text = F.regexp_replace("text", "[\\x00-\\x1f\\x85]", " ")
        line = F.concat("query_id", F.lit("\t"), F.when(F.col("query_id").cast("int") % 4 == 0, F.concat(F.lit("a\tb "), text)).otherwise(text))
        good = self.queries().select(F.when(F.col("query_id").cast("int") % 3 == 0, F.concat(line, F.lit("\x0b"), line, F.lit("x\x85"), line)).otherwise(line).alias("line"))
        return good.unionByName(self.spark.createDataFrame([(x,) for x in BAD_QUERY_LINES], "line string"))

    def answers(self) -> DataFrame:
        """query_id, passage_id, answer: what a structured judge might say."""
        grade = F.col("predicted_relevance").cast("string")
        forms = [F.concat(F.lit(a), grade, F.lit(b)) for a, b in ANSWERS]
        return self.judgments().select("query_id", "passage_id", F.element_at(F.array(*forms), (number("passage_id") % len(ANSWERS) + 1).cast("int")).alias("answer"))

    def shard_text(self) -> DataFrame:
        """file, place, line: corpus shards by doc_id modulo 3; every 97th id says a place one byte off."""
        d = F.col("doc_id")
        rows = self.documents.select(d.alias("place"), *_shard(d), F.md5("text").alias("m"))
        line = F.format_string(SHARD_LINE, "pid", "m", F.lpad(F.col("place").cast("string"), 12, "0"))
        return rows.select("file", "place", line.alias("line"))

    def required(self) -> DataFrame:
        """passage_id of the pool's passages in the first two shards."""
        rows = self._pool().select(F.col("d").alias("place")).where("place % 3 < 2").distinct()
        return rows.select(*_shard(F.col("place"))).select(F.col("pid").alias("passage_id"))

    def shard_qrels(self) -> DataFrame:
        """query_id, passage_id, relevance of the pool's pairs whose passages stand in the first two shards where their ids say."""
        rows = self._pool().select("i", F.col("d").alias("place"), "relevance").where("place % 3 < 2 AND place % 97 <> 5")
        return rows.select(F.col("i").cast("string").alias("query_id"), *_shard(F.col("place")), "relevance").select("query_id", F.col("pid").alias("passage_id"), "relevance")

    def failures(self) -> DataFrame:
        """Failed requests of all kinds, one for each event."""
        e = F.col("event_id")
        pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (e % n + 1).cast("int"))
        headers = F.map_concat(
            F.when(e % 5 == 0, F.create_map(F.lit("retry-after-ms"), (e % 90000).cast("string"))).otherwise(F.create_map().cast("map<string,string>")),
            F.when(e % 4 == 1, F.create_map(F.lit("retry-after"), pick(6, "7", "soon", "nan", "inf", "0.25", "70"))).otherwise(F.create_map().cast("map<string,string>")),
        )
        said = F.when(e % 6 == 2, F.concat(F.lit("Limit: TRY AGAIN in "), (e % 70).cast("string"), F.lit(".5s"))).when(e % 6 == 3, F.concat(F.lit("try again in "), e.cast("string"), F.lit("ms."))).otherwise("none")
        events = self.spark.read.parquet(f"{self.folder}/events.parquet")
        return events.select("event_id", (e % 10).cast("int").alias("attempt"), pick(7, 429, 429, None, 408, 503, 400, 409).cast("int").alias("status"), pick(3, "insufficient_quota", "rate_limit_exceeded", "rate_limit_exceeded").alias("code"), headers.alias("headers"), said.alias("message"))

    def qrel_lines(self) -> DataFrame:
        good = self.qrels().select(F.concat_ws("\t", "query_id", F.lit("0"), "passage_id", F.col("relevance").cast("string")).alias("line"))
        return good.unionByName(self.spark.createDataFrame([(x,) for x in BAD_QREL_LINES], "line string"))


def number(passage_id: str) -> Column:
    """The document's number in a passage id of the first shard."""
    return F.substring(passage_id, len(PREFIX) + 1, 20).cast("bigint")


def _shard(d: Column) -> list[Column]:
    """file and pid of a document in the shards."""
    number = F.concat(F.lit("0"), (d % 3).cast("string"))
    offset = F.floor(d / 3).cast("bigint") * SHARD_BYTES + F.when(d % 97 == 5, 1).otherwise(0)
    return [F.concat(F.lit("msmarco_passage_"), number).alias("file"), F.concat(F.lit("msmarco_passage_"), number, F.lit("_"), F.lpad(offset.cast("string"), 12, "0")).alias("pid")]


_P = PREFIX
SUFFIXES = (".gz", ".txt", ".trec", ".run", ".md", "", ".run.gz", ".json")
SHARD_LINE = '{"pid": "%s", "passage": "%s", "docid": "%s", "spans": "(0,1)"}'
SHARD_BYTES = len(SHARD_LINE % ("msmarco_passage_00_" + "0" * 12, "0" * 32, "0" * 12)) + 1
ANSWERS = (('{"grade": ', "}"), (' { "grade" :', " }\n"), ('{"grade": "', '"}'), ('{"grade": 1', "}"), ('{"grade": ', ".0}"), ('{"grade": ', ', "why": 1}'), ("", ""))
_J = '{"query_id": "1", "passage_id": "a", "human_relevance": 1, "predicted_relevance": %s}'
BAD_JUDGMENT_LINES = (_J % "1.0", _J % "true", _J % '"1"', _J % "[]", "no json", "   ", _J % "2")
BAD_QUERY_LINES = ("no tab", "\tonly text", "only id\t", "   ", "1\tanother text of one", "900\tx\u2028901\ty\u2029\x1c902\t")
BAD_RUN_LINES = (f"1 Q0 {_P}1 1 0.5", f"1 Q0 doc_1 1 0.5 x", f"1 Q0 {_P}1 -1 0.5 x", f"1 Q0 {_P}1 1 nan x", f"1 Q0 {_P}1 1 inf x", f"1 Q0 {_P}1 1 1.0d x", f"1 Q0 {_P}1 1 0x1p3 x", "   ", "", f"  1\tQ0  {_P}1 0 1e-3 x ", f"1 Q0 {_P}2 +3 -.5 x", f"1 Q0 {_P}2 1.5 2 x")
BAD_QREL_LINES = (f"1 0 {_P}1", f"1 0 {_P}1 4", f"1 0 {_P}1 -1", f"1 0 {_P}1 1.0", f"1 0 msmarco_passage_0 1", f"1 0 {_P}1x 1", "  ", f" 1 0  {_P}77 3 ")

#: The same relations for DuckDB, as common table expressions.
SQL = f"""
n AS (SELECT count(*) AS n FROM documents),
fx_queries AS (SELECT CAST(item_id AS VARCHAR) AS query_id, text FROM benchmark),
fx_passages AS (SELECT '{_P}' || doc_id AS passage_id, text, source AS document_id, lang AS spans FROM documents),
pool0 AS (SELECT item_id AS i, (item_id * 101 + j * 7) % n.n AS d FROM benchmark, range({POOL}) AS t(j), n),
pool AS (SELECT i, d, CASE WHEN h < 62 THEN 0 WHEN h < 82 THEN 1 WHEN h < 92 THEN 2 ELSE 3 END AS relevance FROM (SELECT i, d, (i * 31 + d * 17) % 100 AS h FROM pool0)),
fx_qrels AS (SELECT CAST(i AS VARCHAR) AS query_id, '{_P}' || d AS passage_id, CAST(relevance AS INTEGER) AS relevance FROM pool),
fx_judgments AS (SELECT CAST(i AS VARCHAR) AS query_id, '{_P}' || d AS passage_id, CAST(relevance AS INTEGER) AS human_relevance,
  CAST(CASE WHEN (i * 13 + d * 29) % 10 < 6 THEN relevance WHEN (i * 13 + d * 29) % 10 < 8 THEN least(3, relevance + 1) ELSE greatest(0, relevance - 1) END AS INTEGER) AS predicted_relevance,
  CASE WHEN d % 19 <> 0 THEN 200 + d % 300 END AS input_tokens, CASE WHEN d % 19 <> 0 AND d % 17 <> 0 THEN 1 + i % 5 END AS output_tokens,
  [((d * 3 + i * 7) % 8) / CAST(8 AS DOUBLE), ((d * 4 + i * 7) % 8) / CAST(8 AS DOUBLE), ((d * 5 + i * 7) % 8) / CAST(8 AS DOUBLE), ((d * 6 + i * 7) % 8) / CAST(8 AS DOUBLE)] AS probabilities,
  (i + d) % 3 <> 0 AS done FROM pool),
fx_checkpoint AS (SELECT query_id, passage_id, CAST((human_relevance + 1) % 4 AS INTEGER) AS human_relevance, predicted_relevance FROM fx_judgments WHERE done),
runs0 AS (SELECT i, s, CASE WHEN s = {TWIN} THEN {TWIN - 1} ELSE s END AS e, j FROM (SELECT item_id AS i FROM benchmark UNION ALL SELECT {UNJUDGED}), range({SYSTEMS}) AS a(s), range({DEPTH}) AS b(j)
  WHERE NOT (s = {ABSENT_SYSTEM} AND i % 10 = 3)),
runs1 AS (SELECT i, s, e, (i * 101 + (j + e % 5) * 7) % n.n AS d FROM runs0, n),
runs2 AS (SELECT *, (i * 31 + d * 17) % 100 AS h FROM runs1),
fx_runs AS (SELECT 's' || lpad(CAST(s AS VARCHAR), 2, '0') AS run, CASE WHEN i = {UNJUDGED} THEN 'unjudged' ELSE CAST(i AS VARCHAR) END AS query_id, '{_P}' || d AS passage_id,
  CAST((d * (2 * e + 3) * 37 + i * 11) % 64 + e * CASE WHEN h < 62 THEN 0 WHEN h < 82 THEN 1 WHEN h < 92 THEN 2 ELSE 3 END AS DOUBLE) / CAST(64 AS DOUBLE) AS score FROM runs2),
fx_dirty AS (SELECT * FROM fx_qrels UNION ALL VALUES ('0', '{_P}0', 4), ('1', '{_P}1', -1), ('nobody', '{_P}2', 1), ('2', '{_P}missing', 2), ('3', '{_P}3', 0), ('3', '{_P}3', 0)),
fx_run_lines AS (SELECT run, concat_ws(' ', query_id, 'Q0', passage_id, '1', CAST(CAST(score AS DECIMAL(12, 6)) AS VARCHAR), run) AS line FROM fx_runs
  UNION ALL SELECT 'bad', unnest([{", ".join("'" + x.replace(chr(9), "' || chr(9) || '") + "'" for x in BAD_RUN_LINES)}])),
fx_qrel_lines AS (SELECT concat_ws(chr(9), query_id, '0', passage_id, CAST(relevance AS VARCHAR)) AS line FROM fx_qrels UNION ALL SELECT unnest([{", ".join(f"'{x}'" for x in BAD_QREL_LINES)}]))"""
