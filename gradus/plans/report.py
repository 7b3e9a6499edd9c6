"""The report of a judging run: agreement, run metrics, rank correlation, usage and cost."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions.strings import file_label
from gradus.operators import agreement, correlation, judging, ranking, usage
from gradus.operators.validate import InvalidData, check_finite, check_judgments, check_same_pairs
from gradus.schemas import GRADES
from gradus.sources import tables, trec

# Fixed output: how the report says that rankings were evaluated.
EVALUATION = {
    "ndcg_gain": "linear (trec_eval)",
    "binary_relevance_threshold": ranking.RELEVANT,
    "unjudged": "nonrelevant; rankings are not condensed",
    "reference_qrels": "NIST withDupes; includes propagated duplicate labels",
}


def agreement_document(judgments: DataFrame) -> dict:
    cells = agreement.confusion(judgments)
    s = agreement.summary(cells).first()
    counts = [[0] * len(GRADES) for _ in GRADES]
    for r in cells.collect():
        counts[r.human_relevance][r.predicted_relevance] = r.n
    named = {k: s[k] for k in ("count", "agree_count", "exact_agreement", "cohen_kappa", "undefined_reason")}
    return {"labels": list(GRADES), "rows": "human", "columns": "method", "counts": counts, **named, "human_support": list(s.human_support), "method_support": list(s.method_support)}


def correlations_document(means: DataFrame) -> dict:
    rows = correlation.with_p_values(correlation.kendall(correlation.paired(means))).collect()
    return {r.metric: {k: r[k] for k in ("tau_b", "p_value", "system_count", "undefined_reason")} for r in rows}


def scores_document(per_query: DataFrame, means: DataFrame, method: str) -> dict:
    """run to source to aggregate and per_query, nested on the executors; a row for each run reaches the driver."""
    name = F.when(F.col("source") == "predicted", F.lit(method)).otherwise(F.col("source"))
    nest = lambda df, keys: df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    queries = nest(per_query, ["run", "source", "query_id"]).groupBy("run", "source").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "m"))).alias("per_query"))
    both = nest(means, ["run", "source"]).join(queries, ["run", "source"]).withColumn("source", name)
    out: dict = {}
    for r in both.toLocalIterator():
        out.setdefault(r.run, {})[r.source] = {"aggregate": r.m, "per_query": r.per_query}
    return out


def usage_document(judgments: DataFrame, method: str, model: str | None) -> dict:
    """usage and cost. Prices go by the model, but for the probabilistic method by the method itself."""
    pricing = method if method == "probabilistic" else model
    u, price = usage.usage_and_cost(judgments, pricing).first(), usage.PRICES.get(pricing)
    cost = {side: u[f"{side}_cost"] for side in ("input", "output", "total")}
    cost |= {"estimated": True, "model": model, "undefined_reason": None if price else usage.no_price(model), "token_costs_per_million": dict(zip(("input", "output"), price, strict=True)) if price else None}
    return {"usage": {k: u[k] for k in ("input_tokens", "output_tokens", "total_tokens", "judgments_with_usage", "judgments_without_usage")}, "cost": {**cost, "complete": u.complete}}


def sizes(judgments: DataFrame) -> DataFrame:
    """One row: judgment_count, query_count."""
    return judgments.agg(F.count("*").alias("judgment_count"), F.count_distinct("query_id").alias("query_count"))


def figures(judgments: DataFrame, means: DataFrame) -> dict[str, DataFrame]:
    """The data behind each figure, by its file name without suffix."""
    cells = agreement.confusion(judgments)
    scatter = system_scores(means)
    names = scatter.select("figure").distinct().collect()  # one for each metric
    return {"agreement_counts": cells, "agreement_normalized": agreement.normalized(cells)} | {n: scatter.where(F.col("figure") == n).drop("figure") for (n,) in names}


def system_scores(means: DataFrame) -> DataFrame:
    """figure, run, human, predicted: the points of the figure of each metric."""
    return correlation.paired(means).select(F.concat(F.lit("system_scores_"), file_label(F.col("metric"))).alias("figure"), "run", "human", "predicted")


def bounds(pairs: DataFrame) -> DataFrame:
    """Per metric: the least and the greatest score of either assessor."""
    return pairs.groupBy("metric").agg(F.least(F.min("human"), F.min("predicted")).alias("low"), F.greatest(F.max("human"), F.max("predicted")).alias("high"))


def report_document(judgments: DataFrame, means: DataFrame, method: str, model: str | None, known: Mapping, runs: list[dict]) -> dict:
    """The report from judgments and mean scores; its keys are fixed."""
    parts = {"agreement": agreement_document(judgments), "system_rank_correlations": correlations_document(means), **usage_document(judgments, method, model), **sizes(judgments).first().asDict()}
    return {"method": method, "dataset": known.get("dataset"), **parts, "runs": runs, "evaluation": EVALUATION}


def leaves(document: object, name: str = "") -> dict[str, float]:
    """The numbers of a document by the path to each, booleans left out."""
    if isinstance(document, Mapping):
        items = document.items()
    elif isinstance(document, list):
        items = enumerate(document)
    else:
        return {name: float(document)} if isinstance(document, (int, float)) and not isinstance(document, bool) else {}
    return {k: v for key, value in items for k, v in leaves(value, f"{name}.{key}".lstrip(".")).items()}


def performance_report(spark: SparkSession, judgments: DataFrame, method: str, *, run_paths: list[str], folder: str, default_model: str | None = None) -> dict:
    """Compare grades and system rankings on the same judged pairs; writes run_scores.json and results.json to ``folder``/``method``.

    The model is the experiment's, else the first judgment's, else ``default_model``.
    """
    if len(run_paths) < 2:
        raise InvalidData("System orders can't be compared with fewer than two runs")
    judgments = judgments.cache()
    try:
        check_judgments(judgments)
        first = judgments.first()
        if first is None:
            raise InvalidData("Nothing was judged yet")
        output = f"{folder}/{method}"
        known = tables.load_json(f"{output}/experiment.json")
        model = known.get("model", first["model"] if "model" in judgments.columns else default_model)
        graded = judgments.select("query_id", "passage_id", F.col("human_relevance").alias("human"), F.col("predicted_relevance").alias("predicted"))
        per_query = ranking.metrics_per_query(trec.read_runs(spark, run_paths), graded).cache()
        try:
            check_finite(per_query, "value")
            means = ranking.macro_mean(per_query)
            report = report_document(judgments, means, method, model, known, tables.manifest(spark, run_paths))
            tables.save_json(f"{output}/run_scores.json", scores_document(per_query, means, method))
            tables.save_json(f"{output}/results.json", report)
        finally:
            per_query.unpersist()
        return report
    finally:
        judgments.unpersist()


def report_only(spark: SparkSession, folder: str, method: str, qrels: DataFrame, run_paths: list[str]) -> dict:
    """The report of a complete checkpoint, without judging: its pairs must be those of the qrels."""
    rows = trec.read_judgments(spark, f"{folder}/{method}/judgments")
    check_judgments(rows)
    check_same_pairs(rows, qrels)
    return performance_report(spark, judging.refreshed(rows, qrels), method, run_paths=run_paths, folder=folder)
