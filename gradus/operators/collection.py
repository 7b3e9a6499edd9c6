"""Building and summarizing a judged collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions.strings import words
from gradus.operators.validate import check_collection
from gradus.schemas import GRADES
from gradus.sources import tables, trec


def judged_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    return queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi")


def build(spark: SparkSession, query_path: str, qrel_path: str, corpus_paths: list[str], *, cache: str | None = None, check_offsets: bool = False, seek: bool = False) -> dict[str, DataFrame]:
    """The three tables from text files and corpus shards (also in tar archives), checked against each other.

    With ``cache``, a folder of any file system, the passages are kept there under the digest of the judgment file, so that
    a second build with the same judgments reads no shard.
    """
    queries = trec.read_queries(spark, query_path)
    qrels = trec.read_qrels(spark, qrel_path, queries)
    required = qrels.select("passage_id")
    if cache:
        kept = f"{cache}/passages-{tables.manifest(spark, [qrel_path])[0]['sha256']}"
        if not tables.exists(f"{kept}/_SUCCESS"):
            trec.read_corpus(spark, corpus_paths, required, check_offsets=check_offsets, seek=seek).write.mode("overwrite").parquet(kept)
        passages = spark.read.parquet(kept)
    else:
        passages = trec.read_corpus(spark, corpus_paths, required, check_offsets=check_offsets, seek=seek)
    found = {"queries": judged_queries(queries, qrels), "passages": passages, "qrels": qrels}
    check_collection(**found)
    return found


def per_query(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """query_id and its number of judgments, 0 included."""
    counts = qrels.groupBy("query_id").agg(F.count("*").alias("judgments"))
    return queries.select("query_id").join(counts, "query_id", "left").select("query_id", F.coalesce("judgments", F.lit(0).cast("bigint")).alias("judgments"))


def grade_distribution(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """All grades: relevance, judgments, average over all queries."""
    grades = qrels.sparkSession.range(len(GRADES)).select(F.col("id").cast("int").alias("relevance"))
    counts = qrels.groupBy("relevance").agg(F.count("*").alias("judgments"))
    total = queries.agg(F.count("*").alias("_q"))
    rows = grades.join(counts, "relevance", "left").crossJoin(total)  # four rows, one row
    n = F.coalesce("judgments", F.lit(0).cast("bigint"))
    return rows.select("relevance", n.alias("judgments"), F.try_divide(n.cast("double"), F.col("_q").cast("double")).alias("average"))


def summary(queries: DataFrame, passages: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row: sizes, query lengths in words, judged passages per query."""
    n = F.size(words(F.col("text")))
    lengths = queries.agg(F.count("*").alias("number_of_queries"), F.avg(n).alias("words_average"), F.min(n).cast("bigint").alias("words_minimum"), F.max(n).cast("bigint").alias("words_maximum"))
    sizes = [t.agg(F.count("*").alias(name)) for t, name in ((passages, "number_of_passages"), (qrels, "number_of_judgments"))]
    average = per_query(queries, qrels).agg(F.avg("judgments").alias("average_judged_passages_per_query"))
    return lengths.crossJoin(sizes[0]).crossJoin(sizes[1]).crossJoin(average)  # one row each


def summarize(queries: DataFrame, passages: DataFrame, qrels: DataFrame) -> dict:
    """The summary as a document; unjudged passages are allowed."""
    check_collection(queries, passages, qrels, all_judged=False)
    s = summary(queries, passages, qrels).first()
    return {
        "number_of_queries": s.number_of_queries,
        "number_of_passages": s.number_of_passages,
        "number_of_judgments": s.number_of_judgments,
        "query_length_words": {"average": s.words_average, "minimum": s.words_minimum, "maximum": s.words_maximum},
        "average_judged_passages_per_query": s.average_judged_passages_per_query,
        "relevance_grades": {
            str(r.relevance): {"number_of_judgments": r.judgments, "average_judged_passages_per_query": r.average}
            for r in grade_distribution(queries, qrels).orderBy("relevance").collect()
        },
    }


def text_lines(queries: DataFrame, passages: DataFrame, qrels: DataFrame) -> DataFrame:
    """The printed report as a table: line (from 1), text."""
    lines = as_text(summarize(queries, passages, qrels)).split("\n")
    return queries.sparkSession.createDataFrame(list(enumerate(lines, 1)), "line int, text string")


def as_text(s: dict) -> str:
    """The summary as a printed report."""
    words_, grades = s["query_length_words"], s["relevance_grades"]
    # Fixed output: the lines of the report and their formats.
    lines = [
        f"Number of queries: {s['number_of_queries']:,}", f"Number of unique passages: {s['number_of_passages']:,}", f"Number of judgments: {s['number_of_judgments']:,}",
        f"Average query length (words): {words_['average']:.2f}", f"Minimum query length (words): {words_['minimum']}", f"Maximum query length (words): {words_['maximum']}",
        f"Average judged passages per query: {s['average_judged_passages_per_query']:.2f}", "", "Relevance grade | Judgments | Average judged passages per query",
    ]
    return "\n".join(lines + [f"{g:>15} | {v['number_of_judgments']:>9,} | {v['average_judged_passages_per_query']:.2f}" for g, v in sorted(grades.items())])
