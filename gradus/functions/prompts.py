"""What a judge is asked, and the sizes that follow from it."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# The instructions, the graded criteria (index = grade), the budgets, the prices, the efforts and the schema
# of a structured answer.
INSTRUCTIONS = "Rate the passage's relevance to the query using the criteria. Use only information in the passage."
CRITERIA = (
    "Irrelevant: The passage has nothing to do with the query.",
    "Related: The passage seems related to the query but does not answer it.",
    "Highly relevant: The passage has some answer for the query, but the answer may be a bit unclear, or hidden amongst extraneous information.",
    "Perfectly relevant: The passage is dedicated to the query and contains the exact answer.",
)
CHARACTER_BUDGET = 120_000
MARGIN = 2_000
REQUESTS_PER_MINUTE = 450
TOKENS_PER_MINUTE = 180_000
PRICES = {"probabilistic": (0.042, 0.0), "gpt-6-luna": (0.1, 0.5)}  # a million tokens: input, output
EFFORTS = ("none", "low", "medium", "high", "xhigh", "max")
ANSWER_SCHEMA = {
    "additionalProperties": False,
    "properties": {"grade": {"enum": [0, 1, 2, 3], "title": "Grade", "type": "integer"}},
    "required": ["grade"],
    "title": "RelevanceJudgment",
    "type": "object",
}

#: Characters of a request without its query and passage.
REQUEST_CHARS = len(json.dumps({"query": "", "passage": "", "instructions": INSTRUCTIONS, "criteria": list(CRITERIA)}, ensure_ascii=False))


def numbered_instructions() -> str:
    """The instructions followed by one line for each grade."""
    return "\n".join([INSTRUCTIONS, *(f"[{grade}] {text}" for grade, text in enumerate(CRITERIA))])


#: Bytes of a structured request without its query and passage.
PROMPT_BYTES = len((numbered_instructions() + json.dumps(ANSWER_SCHEMA) + json.dumps({"query": "", "passage": ""})).encode())


#: Characters that JSON escapes by one more, and by five more.
SHORT_ESCAPES = '"\\\b\f\n\r\t'
LONG_ESCAPES = "".join(chr(c) for c in range(32) if chr(c) not in SHORT_ESCAPES)


def request_tokens(query: str, passage: str) -> int:
    """``token_estimate`` of one request."""
    size = PROMPT_BYTES + len(json.dumps({"query": query, "passage": passage}, ensure_ascii=False).encode()) - len(json.dumps({"query": "", "passage": ""}))
    return -(-size // 3) + 128


def escapes(text: Column) -> Column:
    """Characters that JSON adds to a string."""
    held = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    return held(SHORT_ESCAPES) + 5 * held(LONG_ESCAPES)


def encoded_bytes(text: Column) -> Column:
    """Bytes of a string in a request."""
    return F.octet_length(text) + escapes(text)


def passage_budget(query: Column, budget: int = CHARACTER_BUDGET, margin: int = MARGIN) -> Column:
    """Characters that a request leaves for the passage: one at least."""
    return F.greatest(F.lit(1), F.lit(budget - margin - REQUEST_CHARS) - F.length(query) - escapes(query))


def token_estimate(query_bytes: Column, passage_bytes: Column) -> Column:
    """A third of the request's bytes, rounded up, and 128."""
    return (F.ceil((query_bytes + passage_bytes + F.lit(PROMPT_BYTES)) / F.lit(3)) + 128).cast("bigint")


def structured_answer(text: Column) -> Column:
    """The grade that a structured answer holds: a whole number of the domain in an object without other keys; else null."""
    answer = F.try_parse_json(text)
    grade = F.try_variant_get(answer, "$.grade", "int")
    return F.when((F.schema_of_variant(answer) == "OBJECT<grade: BIGINT>") & grade.between(0, 3), grade)


def argmax_grade(probabilities: Column) -> Column:
    """The likeliest grade of an array in grade order; of equally likely ones the lowest."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")
