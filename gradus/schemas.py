"""Declared schemas; nothing is ever inferred, since the strictness of grades depends on it."""

from __future__ import annotations

GRADES = (0, 1, 2, 3)

QUERIES = "query_id STRING, text STRING"
PASSAGES = "passage_id STRING, text STRING, document_id STRING, spans STRING"
QRELS = "query_id STRING, passage_id STRING, relevance INT"
RUNS = "run STRING, query_id STRING, passage_id STRING, score DOUBLE"
CORPUS = "pid STRING, passage STRING, docid STRING, spans STRING"
JUDGMENTS = """query_id STRING, passage_id STRING, human_relevance INT, passage_original_chars INT, passage_used_chars INT,
    passage_truncated BOOLEAN, length_retries INT, predicted_relevance INT, score DOUBLE, confidence DOUBLE,
    probabilities MAP<STRING, DOUBLE>, usage STRUCT<input_tokens: BIGINT, output_tokens: BIGINT>, request_id STRING,
    model STRING, latency_seconds DOUBLE"""
FAILURES = "query_id STRING, passage_id STRING, error STRING, type STRING"
