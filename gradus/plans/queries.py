"""The engine's queries over the derived collection, over whole tables."""

from __future__ import annotations

import contextlib
import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions import prompts
from gradus.operators import agreement, collection, correlation, judging, order, ranking, usage, validate
from gradus.plans.fixtures import Fixtures, number
from gradus.sources import archives, tables, trec

BUDGET = 1_000 + prompts.MARGIN + prompts.REQUEST_CHARS  # about 1,000 characters for a passage, so that many are cut
Query = Callable[[SparkSession, str], DataFrame]


def _six(c: str) -> Column:
    return F.round(F.col(c), 6).alias(c)


def _number(c: str) -> Column:
    """A whole number that may be null, as a double: every reader has a null of those."""
    return F.col(c).cast("double").alias(c)


def run_metrics_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    return ranking.metrics_per_query(fx.runs(), fx.graded()).select("run", "source", "query_id", "metric", _six("value"))


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    return ranking.macro_mean(ranking.metrics_per_query(fx.runs(), fx.graded())).select("run", "source", "metric", _six("value"))


def run_metrics_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _means(spark, sf_dir).groupBy("run", "source")
    return wide.agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(a) for m, a in zip(ranking.METRICS, ("ndcg10", "ndcg100", "ap2"), strict=True)])


def ranked_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top(Fixtures(spark, sf_dir).runs(), 10)


def _taus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation.kendall(correlation.paired(_means(spark, sf_dir)))


def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _taus(spark, sf_dir).select("metric", "system_count", "difference", "tied_human", "tied_predicted", _six("tau_b"), _six("z"), "undefined_reason")


def rank_correlation_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation.with_p_values(_taus(spark, sf_dir)).select("metric", "system_count", _six("tau_b"), F.round(F.log10("p_value"), 6).alias("log10_p"))


def system_score_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradus.plans.report import bounds

    return bounds(correlation.paired(_means(spark, sf_dir)))


def agreement_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.confusion(Fixtures(spark, sf_dir).judgments())


def agreement_confusion_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.normalized(agreement_confusion(spark, sf_dir)).select("human_relevance", "predicted_relevance", "n", _six("share"))


def agreement_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = agreement.summary(agreement_confusion(spark, sf_dir))
    supports = [F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("human_support", "method_support")]
    return s.select("count", "agree_count", _six("exact_agreement"), _six("chance_agreement"), _six("cohen_kappa"), "undefined_reason", *supports)


def collection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    s = collection.summary(fx.queries(), fx.passages(), fx.qrels())
    return s.select("number_of_queries", "number_of_passages", "number_of_judgments", _six("words_average"), "words_minimum", "words_maximum", _six("average_judged_passages_per_query"))


def grade_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    return collection.grade_distribution(fx.queries(), fx.qrels()).select("relevance", "judgments", _six("average"))


def judgments_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    return collection.per_query(fx.queries(), fx.qrels())


def pending_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    return judging.pending(fx.qrels(), fx.checkpoint())


def refreshed_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    return judging.refreshed(fx.checkpoint(), fx.qrels())


def judged_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    return collection.judged_queries(fx.queries(), fx.qrels())


def required_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    return fx.passages().join(fx.qrels().select("passage_id").distinct(), "passage_id", "left_semi")


def orphan_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    return validate.orphans(fx.queries(), fx.passages(), fx.dirty())


def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.duplicates(Fixtures(spark, sf_dir).dirty(), "query_id", "passage_id")


def invalid_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.bad_grades(Fixtures(spark, sf_dir).dirty(), "relevance")


def checkpoint_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs on one side only of the dirty qrels and the checkpoint."""
    fx = Fixtures(spark, sf_dir)
    pair = ("query_id", "passage_id")
    left, right = fx.dirty(), fx.checkpoint()
    only = [validate.outside(a, b, *pair).select(*pair, F.lit(name).alias("only_in")).distinct() for a, b, name in ((left, right, "qrels"), (right, left, "checkpoint"))]
    return only[0].unionByName(only[1])


def passage_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    rows = judging.inputs(fx.qrels(), fx.queries(), fx.passages(), BUDGET)
    used = F.length("passage")
    return rows.select("query_id", "passage_id", "passage_original_chars", used.alias("passage_used_chars"), (used < F.col("passage_original_chars")).alias("passage_truncated"), F.md5("passage").alias("digest"))


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    asked = fx.queries().select("query_id", "text", prompts.encoded_bytes(F.col("text")).alias("query_bytes"))
    rows = judging.inputs(fx.qrels(), asked, fx.passages()).join(asked.select("query_id", "query_bytes"), "query_id")
    return rows.select("query_id", "passage_id", prompts.token_estimate(F.col("query_bytes"), F.col("passage_bytes")).alias("tokens"))


def argmax_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("probabilities")
    return Fixtures(spark, sf_dir).judgments().select("query_id", "passage_id", prompts.argmax_grade(p).alias("grade"), F.array_max(p).alias("best"))


def usage_and_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = usage.usage_and_cost(Fixtures(spark, sf_dir).judgments(), "gpt-6-luna")
    return u.select("input_tokens", "output_tokens", "total_tokens", "judgments_with_usage", "judgments_without_usage", *[_six(c) for c in ("input_cost", "output_cost", "total_cost")], "complete", "undefined_reason")


def union_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both assessors' grades as one long table, with what only one of them records left null in the other."""
    j = Fixtures(spark, sf_dir).judgments()
    human = j.select("query_id", "passage_id", F.lit("human").alias("source"), F.col("human_relevance").alias("relevance"))
    method = j.select("query_id", "passage_id", F.lit("method").alias("source"), F.col("predicted_relevance").alias("relevance"), F.col("usage.input_tokens").cast("double").alias("input_tokens"))
    return human.unionByName(method, allowMissingColumns=True)


def _paced(spark: SparkSession, sf_dir: str, key: Column) -> DataFrame:
    """Events as requests, paced for each key by the default budgets, in microseconds."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    cost = F.greatest(F.lit(60_000_000 // prompts.REQUESTS_PER_MINUTE), (200 + F.col("event_id") % 400) * F.lit(60_000_000 // prompts.TOKENS_PER_MINUTE))
    rows = events.select("event_id", "user_id", key.alias("key"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', ts)").alias("at"), cost.alias("cost"))
    return judging.pace_schedule(rows, "key", "at", "cost", "at", "event_id").select("event_id", "user_id", "start", "delay")


def rate_limit_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as requests."""
    return _paced(spark, sf_dir, F.col("user_id"))


def rate_limit_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as requests of one key, paced by one budget."""
    return _paced(spark, sf_dir, F.lit("all"))


def parse_run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trec.parse_run_lines(Fixtures(spark, sf_dir).run_lines()).select("run", "query_id", "passage_id", "score", "problem")


def parse_qrel_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trec.parse_qrel_lines(Fixtures(spark, sf_dir).qrel_lines()).select("query_id", "passage_id", _number("relevance"), "problem")


def judge_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    judged = judging.judge_pairs(judging.inputs(fx.qrels(), fx.queries(), fx.passages()), judging.stub)
    numbers = [_number(c) for c in ("human_relevance", "passage_used_chars", "length_retries", "predicted_relevance")]
    return judged.select("query_id", "passage_id", *numbers, F.col("usage.input_tokens").cast("double").alias("input_tokens"), "error", "type")


def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trec.run_files(Fixtures(spark, sf_dir).file_names())


def parse_judgment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trec.parse_judgment_lines(Fixtures(spark, sf_dir).judgment_lines())
    fine = lambda c: F.when(F.col("problem").isNull(), F.col(c)).alias(c)
    return rows.select(fine("query_id"), fine("passage_id"), *[F.when(F.col("problem").isNull(), F.col(c)).cast("double").alias(c) for c in ("human_relevance", "predicted_relevance")], F.when(F.col("problem").isNull(), F.col("usage.output_tokens")).cast("double").alias("output_tokens"), "line", "problem")


def parse_query_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = Fixtures(spark, sf_dir).query_records()
    return trec.parse_query_lines(records.select(F.explode(F.split("line", trec.STRING_BREAKS)).alias("line"))).select("query_id", "text", "problem")


def conflicting_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with several texts: a repeat of id and text is none."""
    return validate.duplicates(parse_query_lines(spark, sf_dir).where("problem IS NULL").select("query_id", "text").distinct(), "query_id")


def published_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables as they are read again after they were published under a revision and compared with what was written."""
    fx, folder = Fixtures(spark, sf_dir), tables.scratch(spark, "published")
    tables.write_collection({"queries": fx.queries(), "passages": fx.passages(), "qrels": fx.qrels()}, folder, "r1")
    got = tables.read_collection(spark, folder, "r1")
    named = lambda name, key, *rest: got[name].select(F.lit(name).alias("table"), key.alias("key"), F.md5(F.concat_ws(" ", *rest)).alias("digest"))
    both = named("queries", F.col("query_id"), "text").unionByName(named("passages", F.col("passage_id"), "text", "document_id", "spans"))
    return both.unionByName(named("qrels", F.concat_ws(" ", "query_id", "passage_id"), F.col("relevance").cast("string")))


def corpus_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The required passages of tar archives of gzip shards, of those that their ids name, and whether they stand where their ids say."""
    fx = Fixtures(spark, sf_dir)
    required = fx.required()
    paths = archives.pack(fx.shard_text(), tables.scratch(spark, "shards"))
    read = sum(len(trec.own_shards(archives.places(p), required)) for p in paths)
    found = trec.parse_corpus_lines(trec.corpus_lines(spark, paths, required)).join(required, "passage_id", "left_semi")
    wrong = trec.misplaced(found).select("passage_id", F.lit(True).alias("misplaced"))
    rows = found.join(wrong, "passage_id", "left")
    return rows.select("passage_id", "text", "document_id", "spans", "offset", F.coalesce("misplaced", F.lit(False)).alias("misplaced"), F.lit(read).alias("shards_read"))


def corpus_passages_by_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same passages looked up where their ids say, of shards that aren't compressed; those that aren't there have no text."""
    fx = Fixtures(spark, sf_dir)
    paths = tables.write_files(fx.shard_text(), tables.scratch(spark, "shards"))
    return trec.passages_at(fx.required(), paths).select("passage_id", "run", "text", "document_id", "spans", "offset")


def _metadata(fx: Fixtures, folder: str) -> list[str]:
    """The paths of a query file and of a judgment file, whose lines go by the digest of their pairs."""
    plain = F.regexp_replace("text", r"[\x00-\x1f\x85\u2028\u2029]", " ")
    asked = fx.queries().select(F.lit("q.tsv").alias("file"), F.col("query_id").alias("place"), F.concat("query_id", F.lit("\t"), plain).alias("line"))
    pair = F.concat_ws(" ", "query_id", "passage_id")
    judged = fx.shard_qrels().select(F.lit("r.txt").alias("file"), F.concat(F.md5(pair), pair).alias("place"), F.concat_ws(" ", "query_id", F.lit("0"), "passage_id", F.col("relevance").cast("string")).alias("line"))
    return tables.write_files(asked.unionByName(judged), folder)


def built_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of a collection that was built from text files and archives, whose passages come from the cache the second time."""
    fx, folder = Fixtures(spark, sf_dir), tables.scratch(spark, "built")
    query_path, qrel_path = _metadata(fx, folder)
    paths = archives.pack(fx.shard_text(), f"{folder}/shards")
    collection.build(spark, query_path, qrel_path, paths, cache=f"{folder}/cache", check_offsets=True)
    got = collection.build(spark, query_path, qrel_path, [], cache=f"{folder}/cache")
    both = got["queries"].select(F.lit("queries").alias("table"), F.col("query_id").alias("key"), F.md5("text").alias("digest")).unionByName(got["passages"].select(F.lit("passages").alias("table"), F.col("passage_id").alias("key"), F.md5(F.concat_ws(" ", "text", "document_id", "spans")).alias("digest")))
    return both.unionByName(got["qrels"].select(F.lit("qrels").alias("table"), F.concat_ws(" ", "query_id", "passage_id").alias("key"), F.md5(F.col("relevance").cast("string")).alias("digest")))


def qrels_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged pairs with their places in the judgment file, as the order in which a checkpoint's labels are read anew."""
    fx, folder = Fixtures(spark, sf_dir), tables.scratch(spark, "order")
    query_path, qrel_path = _metadata(fx, folder)
    qrels = trec.read_qrels(spark, qrel_path, trec.read_queries(spark, query_path), order=True)
    return order.with_positions(qrels, "seq").select("query_id", "passage_id", _number("relevance"), "position")


def missing_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten of the required passages that no table has."""
    fx = Fixtures(spark, sf_dir)
    required = fx.dirty().select("passage_id").unionByName(fx.required())
    return trec.missing_passages(required, fx.passages()).orderBy("passage_id").limit(10)


def unknown_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    return trec.unknown_queries(fx.dirty(), fx.queries())


def collection_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    twice = fx.queries().unionByName(fx.queries().where("query_id IN ('1', '7')"))
    return validate.collection_violations(twice, fx.passages(), fx.dirty())


def summary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    return collection.text_lines(fx.queries(), fx.passages(), fx.qrels())


def figure_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradus.plans.report import system_scores

    return system_scores(_means(spark, sf_dir)).select("figure", "run", _six("human"), _six("predicted"))


def judge_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the instructions for each query, and the characters that its request takes without a passage."""
    asked = Fixtures(spark, sf_dir).queries()
    size = (F.lit(prompts.REQUEST_CHARS) + F.length("text") + prompts.escapes(F.col("text"))).alias("request_chars")
    return asked.select("query_id", F.posexplode(F.split(F.lit(prompts.numbered_instructions()), "\n")).alias("place", "line"), size)


def structured_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fixtures(spark, sf_dir).answers().select("query_id", "passage_id", prompts.structured_answer(F.col("answer")).cast("double").alias("grade"))


def experiment_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the judgments of each query, as if of a folder each, may be gone on with: some have no signature, or of other grades."""
    fx, i = Fixtures(spark, sf_dir), F.col("query_id").cast("bigint")
    graded = F.array_sort(F.collect_list(F.concat_ws(":", "passage_id", F.col("predicted_relevance").cast("string"))))
    marks = fx.judgments().groupBy("query_id").agg(F.sha2(F.array_join(graded, ","), 256).alias("mark"))
    done = fx.checkpoint().groupBy("query_id").agg(graded.alias("done"))
    known = F.when(i % 3 == 0, F.lit(None)).when(i % 3 == 1, F.sha2(F.array_join("done", ","), 256)).otherwise(F.col("mark"))
    rows = marks.join(done.where("query_id NOT LIKE '%7'"), "query_id", "left")
    return rows.select("query_id", judging.experiment_problem(known, F.col("mark"), F.col("done").isNull()).alias("problem"))


def judge_probabilistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments by probabilities: of each pair the grade, and every grade's probability by its name."""
    fx = Fixtures(spark, sf_dir)
    judged = judging.judge_pairs(judging.inputs(fx.qrels(), fx.queries(), fx.passages()), judging.weighing)
    return judged.select("query_id", "passage_id", _number("predicted_relevance"), "score", "confidence", "model", F.explode("probabilities").alias("grade", "probability"))


def judge_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a whole run leaves in its checkpoint, with a judge that is limited, lost, refused and too long by rule."""
    fx, folder = Fixtures(spark, sf_dir), tables.scratch(spark, "judged")
    given = {"queries": fx.queries(), "passages": fx.passages(), "qrels": fx.qrels()}
    with contextlib.suppress(RuntimeError):  # that some pairs failed
        judging.run(spark, given, folder, judging.scripted, model="scripted", concurrency=8, rounds=3, pace=judging.untimed, wait=lambda _: math.inf)
    done = trec.read_judgments(spark, f"{folder}/judgments").select("query_id", "passage_id", *[_number(c) for c in ("human_relevance", "predicted_relevance", "passage_used_chars", "length_retries")], F.col("usage.output_tokens").cast("double").alias("repeats"), (F.col("latency_seconds") >= 0).alias("timed"))
    failed = trec.read_failures(spark, f"{folder}/judgments").select("query_id", "passage_id", "error", "type")
    listed = tables.load_json(f"{folder}/failures.json")
    both = done.unionByName(failed, allowMissingColumns=True).withColumn("timed", F.coalesce("timed", F.lit(False)))
    return both.withColumn("failures", F.lit(len(listed)).cast("bigint"))


def judge_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments of a run that failed for a third of the pairs and was gone on with by another judge; a third run finds nothing to do."""
    fx, folder = Fixtures(spark, sf_dir), tables.scratch(spark, "resumed")
    given = {"queries": fx.queries(), "passages": fx.passages(), "qrels": fx.qrels()}
    with contextlib.suppress(RuntimeError):  # that some pairs failed
        judging.run(spark, given, folder, judging.choosy, model="two", concurrency=4, rounds=2)
    judging.run(spark, given, folder, judging.second, model="two", concurrency=4, rounds=2)
    done = judging.run(spark, given, folder, judging.scripted, model="two", concurrency=4, rounds=2)
    return done.select("query_id", "passage_id", _number("human_relevance"), _number("predicted_relevance"), "model")


def deferred_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the pairs that a run asked again: how often they had been asked, as the rows say by which it put them off."""
    fx, folder = Fixtures(spark, sf_dir), tables.scratch(spark, "deferred")
    given = judging.inputs(fx.qrels(), fx.queries(), fx.passages())
    judging.judge_chunks([("first", given)], folder, judging.scripted, tasks=8, pace=judging.untimed, wait=lambda _: math.inf)
    later = trec.read_deferred(spark, folder).where("attempt > 0")
    return later.groupBy("query_id", "passage_id").agg(F.max("attempt").cast("double").alias("attempts"), F.countDistinct("chunk").cast("double").alias("rounds"), (F.min("not_before") > 0).alias("timed"))


def equal_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether tables have the same rows as often, by their digests: in another order, with one row twice for another, with other labels."""
    fx = Fixtures(spark, sf_dir)
    qrels, stale = fx.qrels(), fx.qrels().withColumn("relevance", F.when(F.col("query_id") == "1", F.lit(None)).otherwise(F.col("relevance")))
    twice = fx.dirty().where("query_id <> '3'").unionByName(fx.dirty().where("query_id = '2'"))
    pairs = [("qrels again", qrels, qrels.repartition(7)), ("dirty and qrels", fx.dirty(), qrels), ("dirty and one with repeats", fx.dirty(), twice), ("no labels of a query", qrels, stale), ("passages again", fx.passages(), fx.passages().orderBy(F.desc("passage_id")))]
    found = [validate.same_rows(a, b).select(F.lit(name).alias("tables"), "same", "left_rows", "right_rows") for name, a, b in pairs]
    return reduce(DataFrame.unionByName, found)


def ordered_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the judged pairs in the order of their ids, and from the last to the first."""
    rows = Fixtures(spark, sf_dir).qrels()
    ids, columns = ["query_id", "passage_id"], ["query_id", "passage_id", "relevance"]
    back = rows.withColumn("n", -F.col("query_id").cast("bigint")).withColumn("d", -number("passage_id"))
    found = [("by id", order.fingerprint(rows, ids, columns)), ("backwards", order.fingerprint(back, ["n", "d"], columns))]
    return spark.createDataFrame(found, "name string, sha256 string")


def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of failed requests, whether they are asked again, and the wait that they put off others by."""
    return judging.retry_plan(Fixtures(spark, sf_dir).failures()).select("event_id", "again", _six("delay"))


def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run files by name, with the digest of their bytes."""
    paths = tables.write_files(Fixtures(spark, sf_dir).run_text(), tables.scratch(spark, "runs"))
    return spark.createDataFrame([(r["file"], r["sha256"]) for r in tables.manifest(spark, paths)], "file string, sha256 string")


def report_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number of a report that was written from judgments and run files and read again."""
    from gradus.plans import report

    fx, folder = Fixtures(spark, sf_dir), tables.scratch(spark, "report")
    paths = tables.write_files(fx.run_text(), f"{folder}/runs")
    report.performance_report(spark, fx.judgments().drop("probabilities", "done"), "structured", run_paths=paths, folder=folder, default_model="gpt-6-luna")
    found = report.leaves(tables.load_json(f"{folder}/structured/results.json"))
    return spark.createDataFrame([(k, round(v, 6)) for k, v in found.items()], "name string, value double")


def not_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that no JSON document may hold, among scores of which some are made NaN or infinite."""
    at = (number("passage_id") * 7 + F.substring("run", 2, 9).cast("int")) % 50
    score = F.when(at == 0, F.lit(float("nan"))).when(at == 1, F.lit(float("-inf"))).when(at == 2, F.lit(None)).otherwise(F.col("score"))
    return validate.not_finite(Fixtures(spark, sf_dir).runs().withColumn("score", score), "score").select("run", "query_id", "passage_id")


def queries() -> dict[str, Query]:
    names = """run_metrics_aggregate run_metrics_per_query ranked_top10 rank_correlation rank_correlation_pvalue system_score_bounds agreement_confusion
        agreement_confusion_normalized agreement_summary collection_summary grade_distribution judgments_per_query pending_judgments refreshed_judgments
        judged_queries required_passages orphan_references duplicate_pairs invalid_grades checkpoint_difference passage_truncation token_estimates
        argmax_grades usage_and_cost union_of_sources rate_limit_schedule rate_limit_shared parse_run_lines parse_qrel_lines judge_stub run_files parse_judgment_lines
        parse_query_lines conflicting_queries published_collection corpus_passages corpus_passages_by_offset built_collection qrels_in_order missing_passages unknown_queries collection_violations summary_report
        figure_points judge_prompt structured_answers experiment_guard judge_probabilistic judge_run judge_resumed deferred_requests
        equal_tables ordered_fingerprint retry_schedule run_manifest report_numbers not_finite"""
    return {name: globals()[name] for name in names.split()}
