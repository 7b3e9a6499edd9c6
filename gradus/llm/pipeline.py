"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns documents.

All of them keep whatever columns ``docs`` has, in order, also those named like a column that an operator adds. An empty
table stays empty; rows that repeat are judged alike. ``n_chars`` and ``source`` may be missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm import decontaminate, jaccard, language, mixing, secrets
from gradus.llm.queries import PIECES, WEIGHTS, secret_forest, table

#: Of four learned languages a text that speaks for none has about 0.25 to 0.3; the least of clean documents was 0.49.
LEAST_SCORE = 0.35
LEAST_FIT = -0.1  # of language.identify: the score alone can't tell an unlearned language from its nearest learned one


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of these names renamed, and their new names."""
    taken, moved = {c.lower() for c in docs.columns}, {}
    for c in docs.columns:
        if c.lower() in names:
            moved[c] = c
            while moved[c].lower() in taken:
                moved[c] += "_"
            taken.add(moved[c].lower())
    return docs.withColumnsRenamed(moved), moved


def _back(docs: DataFrame, judged: DataFrame, moved: dict[str, str], **changed) -> DataFrame:
    """The columns of ``docs`` as they were, but for those of ``changed``."""
    return judged.select(*[changed.get(c, F.col(f"`{moved.get(c, c)}`")).alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null and empty texts too), those of no clear language, and those that no learned language explains.

    A null ``lang`` of a document that stays becomes the language found; given ones stay. Without a labelled text nothing
    is learned, and all documents go.
    """
    model = language.train(docs.where(~language.held_out()), PIECES)
    given, moved = _aside(docs, "_lang", "_score", "_fit")
    judged = language.identify(given, model, pred="_lang", score="_score", fit="_fit")
    kept = judged.where((F.col("_lang") != language.UNDETERMINED) & (F.col("_score") >= LEAST_SCORE) & (F.col("_fit") >= LEAST_FIT))
    return _back(docs, kept, moved, lang=F.coalesce("lang", "_lang"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest doc_id, of each group that links of 0.8 over five words connect.

    Null and empty texts link with nothing and stay. Of rows that repeat id and text one stays; a null id stays unless it
    repeats another null id's text.
    """
    return jaccard.keep_first(docs, width=5, similarity="0.8")


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of the texts and brings n_chars up to date; a document of nothing else goes.

    Null, empty and untouched texts stay as they are.
    """
    given, moved = _aside(docs, "_hits")
    return _back(docs, decontaminate.cut(given, table(spark, sf_dir, "benchmark")), moved)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mask in the place of each secret and brings n_chars up to date; no document goes, and a null text stays null."""
    given, moved = _aside(docs, "_candidates", "_secrets", "_redacted")
    found = secrets.scan(given, secret_forest(), path="source" if "source" in docs.columns else None)
    changed = {"text": F.col("_redacted")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("_secrets") > 0, F.length("_redacted").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return _back(docs, found, moved, **changed)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents to the target weights of their sources, in a global random order; adds copy_no.

    A null source is a source of its own; a column that is named copy_no already stays under that name with _ behind it.
    Without a column ``source`` all documents are of one source.
    """
    given, _ = _aside(docs, "copy_no")
    if "source" in docs.columns:
        return mixing.mix_sources(given, WEIGHTS)
    return mixing.mix_sources(given.withColumn("source", F.lit(None).cast("string")), WEIGHTS).drop("source")
