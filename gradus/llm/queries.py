"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm import chat, collocations, decontaminate, jaccard, language, licences, mixing, neighbours, panes, secrets, substrings, urls, warc
from gradus.llm._store import shared_dir

VOCABULARIES = os.environ.get("GRADUS_VOCABULARIES", "/opt/tokenizers")
CHAT_VOCABULARY = f"{VOCABULARIES}/byte_bpe_50k.tiktoken"
PIECES = f"{VOCABULARIES}/piece_bpe_32k.model"
#: Target shares of the mix: the first source is held to a tenth, a few are raised, the rest weigh 1.
WEIGHTS = {"src0": 2.0, "src1": 3.0, "src2": 0.5, "src3": 1.5}

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
FINDINGS, FINDINGS_SEED = 4000, 23


def secret_forest() -> secrets.Forest:
    return secrets.train(secrets.invented_findings(FINDINGS, FINDINGS_SEED), secrets.dictionary(CHAT_VOCABULARY))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where a url names the document that its page was made from: the last number of its path.
DOCUMENT = r"([0-9]+)[^0-9/]*/?$"


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, bad: pages made from a labelled document, bad if it is toxic or of low quality."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    number = F.regexp_extract(urls.host_and_path(F.col("url"))[1], DOCUMENT, 1).try_cast("bigint")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return pages.select("url", number.alias("doc_id")).join(labels.select("doc_id", bad.alias("bad")), "doc_id").select("url", "bad")


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES, labelled=page_labels(spark, sf_dir))


def op2_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = secrets.scan(docs, secret_forest(), path="source")
    spans = F.array_join(F.transform("_secrets", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", F.col("_candidates").alias("n_candidates"), F.size("_secrets").cast("bigint").alias("n_secrets"), spans.alias("spans"), F.sha2("_redacted", 256).alias("redacted_sha256"))


def op3_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), WEIGHTS)


def op4_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), width=4, similarity="0.85")


def op5_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], chats.schema)
    return chat.chat_digests(chats.unionByName(own), CHAT_VOCABULARY)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(~language.held_out()), PIECES)
    own = docs.select("doc_id", language.held_out().alias("held_out"), "text")
    return language.identify(own, model).select("doc_id", "held_out", "lang_pred", "score")


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(substrings.drop_repeats(table(spark, sf_dir, "documents"), width=35))


def op8_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op9_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"), licences.common())


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digests(decontaminate.mark(docs, table(spark, sf_dir, "benchmark")))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), longest=5, least=100, top=2000)


def op12_pane_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = panes.revise(panes.click_batches(table(spark, sf_dir, "clicks"), 10), 10)
    return found.select(F.col("batch").cast("bigint").alias("batch"), "record", "kind", "hour", "click_id", "n_rows", "cents")


def op13_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("binary").alias("payload"))
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.store(warc.records(pages), pages, folder)
    return warc.digests(warc.restore(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
