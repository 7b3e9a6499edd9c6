from __future__ import annotations

import re

from pyspark.sql import functions as F

import corpus_pipeline
from gradus.llm import decontaminate, language, mixing, pipeline, queries, secrets
from tests.conftest import SMALL
from tests.llm.test_jaccard import brute


def test_stages_against_plain_code(spark):
    """Each stage by a plain rule on the driver: its model's verdicts one by one, all pairs, searched passages."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = language.train(docs.where(~language.held_out()), queries.PIECES)
    said = {r.doc_id: r for r in language.identify(docs, model).collect()}
    fits = {r.doc_id: r.fit for r in language.identify(docs, model, fit="fit").collect()}
    kept = {i: r.text for i, r in rows.items() if said[i].lang_pred != "und" and said[i].score >= pipeline.LEAST_SCORE and fits[i] >= pipeline.LEAST_FIT}
    from fractions import Fraction

    kept = {i: kept[i] for i, (_, c) in brute(list(kept.items()), 5, Fraction("0.8")).items() if i == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = set()
    for _, text in items:
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        phrases |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))}
    cut = {}
    for i, text in kept.items():
        at = list(word.finditer(re.sub("[A-Z]", lambda m: m[0].lower(), text)))
        hit = set()
        for k in range(len(at)):
            for n in {len(p) for p in phrases}:
                if tuple(m.group() for m in at[k : k + n]) in phrases:
                    hit.update(range(k, k + n))
        if len(hit) == len(at):
            continue
        out, here = "", 0
        for k in sorted(hit):
            if k - 1 not in hit:
                out += text[here : at[k].start()]
            here = at[k].end()
        cut[i] = out + text[here:]
    forest = queries.secret_forest()
    clean = spark.createDataFrame([(i, t, rows[i].source) for i, t in cut.items()], "doc_id long, text string, source string")
    masked = secrets.scan(clean, forest, path="source").select("doc_id", "_redacted", "source").withColumnRenamed("_redacted", "text")
    want = sorted((r.doc_id, r.text, r.copy_no) for r in mixing.mix_sources(masked, queries.WEIGHTS).collect())
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == [*docs.columns, "copy_no"]
    out = got.collect()
    mine = sorted((r.doc_id, r.text, r.copy_no) for r in out)
    assert [x for x in mine if x not in want] == [x for x in want if x not in mine] == []
    assert len(mine) == len(want)
    assert all(r.n_chars == len(r.text) and r.source == rows[r.doc_id].source for r in out)


def test_stages_on_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int, `_hits` int, `_n` int, COPY_NO int, key string"
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, None, None, None, None), (None, "the and of that this", "en", "a", 20), (3, "", "en", "a", 0), (4, "the one thing that was with the other", "en", "a", 37), (4, "the one thing that was with the other", "en", "a", 37), (5, long, None, None, None)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, "k") for r in rows], schema)
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, SMALL)
            last = name == "mixing sources"
            assert out.columns == ([*[c + "_" * (c == "COPY_NO") for c in docs.columns], "copy_no"] if last else docs.columns), name
            found = out.collect()
            ids = [r.doc_id for r in found]
            assert all((r["score"], r["_hits"], r["_n"], r["COPY_NO_" if last else "COPY_NO"], r.key) == (1, 2, 3, 4, "k") for r in found), name
            assert (last or 4 in ids and 5 in ids or given is not docs) and (name != "n-gram Jaccard join" or ids.count(4) <= 1), name
            assert given is docs or not ids


def test_stages_without_optional_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").drop("source", "n_chars").limit(20)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.columns == [*docs.columns, *["copy_no"] * (name == "mixing sources")] and out.count() > 0, name


def test_a_missing_language_is_filled_in(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bare = docs.withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang")))
    got = {r.doc_id: r.lang for r in pipeline.identify_language(spark, bare, SMALL).collect()}
    want = {r.doc_id: r.lang for r in docs.collect()}
    assert all(got[i] == want[i] for i in got if i % 5) and sum(got[i] == want[i] for i in got if i % 5 == 0) >= 0.95 * sum(i % 5 == 0 for i in got)


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert pipeline.identify_language(spark, docs, SMALL).count() == docs.count()
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    marked = decontaminate.mark(docs, bench)
    untouched = marked.where("size(_hits.spans) = 0").select("doc_id", "text")
    assert untouched.exceptAll(decontaminate.remove(marked).select("doc_id", "text")).count() == 0


def test_unlearned_languages_and_gibberish_go(spark):
    import random

    r = random.Random(1)
    noise = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(60))
    texts = [
        noise, "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.", "Все люди рождаются свободными и равными в своем достоинстве и правах.",
        "ມະນຸດທຸກຄົນເກີດມາມີກຽດສັກສິດສິດທິເສລີພາບແລະຄວາມສະເໝີພາບເທົ່າທຽມກັນທຸກຄົນມີເຫດຜົນ" * 3,
    ]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate(texts)], docs.schema)
    kept = {row.doc_id for row in pipeline.identify_language(spark, docs.unionByName(more), SMALL).collect()}
    assert kept == {row.doc_id for row in docs.collect()}


def test_long_words_of_no_pieces_have_scores(spark):
    import numpy as np

    model = language.fit({"a": {"the": 5}, "b": {"und": 5}}, queries.PIECES)
    assert np.isfinite(language.word_scores(["\U00012000" * 40], model)).all()
