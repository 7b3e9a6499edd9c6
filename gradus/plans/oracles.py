"""DuckDB SQL with the results of the engine's queries."""

from __future__ import annotations

from gradus.functions import prompts
from gradus.operators.agreement import NO_VARIATION
from gradus.operators.correlation import CONSTANT
from gradus.operators.judging import PASSING
from gradus.operators.ranking import RELEVANT
from gradus.plans.fixtures import ANSWERS, BAD_JUDGMENT_LINES, BAD_QUERY_LINES, PREFIX, SHARD_BYTES, SQL, SUFFIXES
from gradus.plans.queries import BUDGET

_SUM10 = "sum(CASE WHEN rank <= {k} THEN CAST({g} AS DOUBLE) / log2(rank + 1) ELSE 0 END)"
_METRICS = f"""
grades AS (SELECT query_id, passage_id, 'human' AS source, human_relevance AS rel FROM fx_judgments UNION ALL SELECT query_id, passage_id, 'predicted', predicted_relevance FROM fx_judgments),
sources AS (SELECT DISTINCT source FROM grades),
rows_ AS (SELECT run, query_id, passage_id, row_number() OVER (PARTITION BY run, query_id ORDER BY score DESC, passage_id DESC) AS rank FROM fx_runs WHERE query_id IN (SELECT query_id FROM fx_queries)),
graded AS (SELECT r.run, r.query_id, s.source, r.rank, coalesce(g.rel, 0) AS rel FROM rows_ r CROSS JOIN sources s LEFT JOIN grades g ON g.query_id = r.query_id AND g.passage_id = r.passage_id AND g.source = s.source),
hits AS (SELECT *, sum(CASE WHEN rel >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY run, query_id, source ORDER BY rank) AS so_far FROM graded),
found AS (SELECT run, query_id, source, {_SUM10.format(k=10, g="rel")} AS g10, {_SUM10.format(k=100, g="rel")} AS g100, sum(CASE WHEN rel >= 2 THEN CAST(so_far AS DOUBLE) / rank ELSE 0 END) AS ap FROM hits GROUP BY ALL),
best AS (SELECT query_id, source, rel, row_number() OVER (PARTITION BY query_id, source ORDER BY rel DESC) AS rank FROM grades),
ideal AS (SELECT query_id, source, {_SUM10.format(k=10, g="rel")} AS i10, {_SUM10.format(k=100, g="rel")} AS i100, sum(CASE WHEN rel >= 2 THEN 1 ELSE 0 END) AS n FROM best GROUP BY ALL),
wide AS (SELECT r.run, i.source, i.query_id, CASE WHEN i10 > 0 THEN coalesce(g10, 0) / i10 ELSE 0 END AS m10, CASE WHEN i100 > 0 THEN coalesce(g100, 0) / i100 ELSE 0 END AS m100, CASE WHEN n > 0 THEN coalesce(ap, 0) / n ELSE 0 END AS map
  FROM (SELECT DISTINCT run FROM fx_runs) r CROSS JOIN ideal i LEFT JOIN found f ON f.run = r.run AND f.query_id = i.query_id AND f.source = i.source),
per_query AS (SELECT run, source, query_id, 'nDCG@10' AS metric, m10 AS value FROM wide UNION ALL SELECT run, source, query_id, 'nDCG@100', m100 FROM wide UNION ALL SELECT run, source, query_id, 'AP(rel=2)', map FROM wide),
means AS (SELECT run, source, metric, round(avg(value), 6) AS value FROM per_query GROUP BY ALL),
paired AS (SELECT run, metric, max(value) FILTER (source = 'human') AS h, max(value) FILTER (source = 'predicted') AS p FROM means GROUP BY ALL)"""
_TAU = """
pairs AS (SELECT a.metric, CAST(sum(sign(a.h - b.h) * sign(a.p - b.p)) AS BIGINT) AS difference FROM paired a JOIN paired b ON a.metric = b.metric AND a.run < b.run GROUP BY a.metric),
th AS (SELECT metric, sum(t * (t - 1) // 2) AS n1, sum(t * (t - 1) * (t - 2)) AS x0, sum(t * (t - 1) * (2 * t + 5)) AS x1 FROM (SELECT metric, h, count(*) AS t FROM paired GROUP BY ALL) GROUP BY metric),
tp AS (SELECT metric, sum(t * (t - 1) // 2) AS n2, sum(t * (t - 1) * (t - 2)) AS y0, sum(t * (t - 1) * (2 * t + 5)) AS y1 FROM (SELECT metric, p, count(*) AS t FROM paired GROUP BY ALL) GROUP BY metric),
counted AS (SELECT metric, count(*) AS n FROM paired GROUP BY metric),
taus AS (SELECT metric, n, difference, n1, n2, CAST(n * (n - 1) // 2 - n1 AS DOUBLE) * CAST(n * (n - 1) // 2 - n2 AS DOUBLE) AS prod,
  (CAST(n * (n - 1) AS DOUBLE) * (2 * n + 5) - x1 - y1) / 18 + 2 * CAST(n1 AS DOUBLE) * n2 / (n * (n - 1)) + CAST(x0 AS DOUBLE) * y0 / (9 * CAST(n * (n - 1) AS DOUBLE) * (n - 2)) AS var
  FROM counted JOIN pairs USING (metric) JOIN th USING (metric) JOIN tp USING (metric))"""
#: Of the normal tail from z on: area * exp(-z * z / 2) * sqrt(2 / pi) is the two-sided p-value. Simpson's rule.
_AREA = """
areas AS (SELECT metric, n, difference, prod, z, sum(exp(-z * x - x * x / 2) * CASE WHEN k IN (0, 24000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * CAST(0.0005 AS DOUBLE) / 3 AS area
  FROM (SELECT *, abs(difference / sqrt(var)) AS z FROM taus), (SELECT k, k * CAST(0.0005 AS DOUBLE) AS x FROM range(24001) AS t(k)) GROUP BY ALL)"""
_CONFUSION = """
cells AS (SELECT CAST(a.g AS INTEGER) AS human_relevance, CAST(b.g AS INTEGER) AS predicted_relevance, count(j.query_id) AS n FROM range(4) AS a(g) CROSS JOIN range(4) AS b(g)
  LEFT JOIN fx_judgments j ON j.human_relevance = a.g AND j.predicted_relevance = b.g GROUP BY ALL)"""
_SUMMARY = """
hs AS (SELECT human_relevance AS g, sum(n) AS n FROM cells GROUP BY ALL), ps AS (SELECT predicted_relevance AS g, sum(n) AS n FROM cells GROUP BY ALL),
one AS (SELECT CAST(sum(n) AS BIGINT) AS c, CAST(sum(n) FILTER (human_relevance = predicted_relevance) AS BIGINT) AS a FROM cells),
chance AS (SELECT CAST(sum(hs.n * ps.n) AS BIGINT) AS e FROM hs JOIN ps USING (g))"""
_ESC = "(length(regexp_replace({0}, '[^\"\\\\\\x08\\x0c\\n\\r\\t]', '', 'g')) + 5 * length(regexp_replace({0}, '[^\\x00-\\x07\\x0b\\x0e-\\x1f]', '', 'g')))"
_INPUTS = """
inputs AS (SELECT query_id, passage_id, relevance, q.text AS query, p.text AS whole, substr(p.text, 1, greatest(1, {left} - length(q.text) - {esc})) AS passage
  FROM fx_qrels JOIN fx_queries q USING (query_id) JOIN fx_passages p USING (passage_id))"""


def _inputs(budget: int) -> str:
    return _INPUTS.format(left=budget - prompts.MARGIN - prompts.REQUEST_CHARS, esc=_ESC.format("q.text"))


_WORDS = r"regexp_extract_all({}, '[^\s\p{{Z}}\x1c-\x1f\x85]+')"
_FINITE = r"CASE WHEN regexp_full_match({0}, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast({0} AS DOUBLE) END"
_WHOLE = r"CASE WHEN regexp_full_match({0}, '[+-]?[0-9]+') THEN try_cast(ltrim({0}, '+') AS INTEGER) END"


def _text(x: str) -> str:
    """An SQL string; characters below the space and line breaks of strings by their numbers."""
    out, plain = [], ""
    for c in x:
        if c < " " or c in "\x85\u2028\u2029":
            out += ([f"'{plain}'"] if plain else []) + [f"chr({ord(c)})"]
            plain = ""
        else:
            plain += c.replace("'", "''")
    return " || ".join(out + ([f"'{plain}'"] if plain or not out else []))


_LIST = lambda values: "[" + ", ".join(map(_text, values)) + "]"
_SHARD = f"""
placed AS (SELECT doc_id, doc_id % 3 AS k, (doc_id // 3) * {SHARD_BYTES} AS place, md5(text) AS text FROM documents),
shards AS (SELECT doc_id, k, '{PREFIX[:-3]}0' || k || '_' || lpad(CAST(place + CASE WHEN doc_id % 97 = 5 THEN 1 ELSE 0 END AS VARCHAR), 12, '0') AS passage_id, text, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS document_id, place FROM placed),
wanted AS (SELECT DISTINCT d FROM pool WHERE d % 3 < 2)"""
_SHARD_QRELS = "judged AS (SELECT CAST(i AS VARCHAR) AS query_id, passage_id, relevance FROM pool JOIN shards ON doc_id = d WHERE d % 3 < 2 AND d % 97 <> 5)"
_RECORDS = f"""
records AS (SELECT CASE WHEN CAST(query_id AS INTEGER) % 3 = 0 THEN line || chr(11) || line || 'x' || chr(133) || line ELSE line END AS line FROM (
  SELECT query_id, query_id || chr(9) || CASE WHEN CAST(query_id AS INTEGER) % 4 = 0 THEN 'a' || chr(9) || 'b ' ELSE '' END || regexp_replace(text, '[\\x00-\\x1f\\x{{85}}]', ' ', 'g') AS line FROM fx_queries)
  UNION ALL SELECT unnest({_LIST(BAD_QUERY_LINES)})),
query_lines AS (SELECT * FROM (SELECT unnest(regexp_split_to_array(line, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')) AS line FROM records) WHERE len({_WORDS.format("line")}) > 0),
parsed AS (SELECT CASE WHEN instr(line, chr(9)) > 0 THEN substr(line, 1, instr(line, chr(9)) - 1) ELSE line END AS query_id, CASE WHEN instr(line, chr(9)) > 0 THEN substr(line, instr(line, chr(9)) + 1) END AS text FROM query_lines),
queries_ AS (SELECT query_id, text, CASE WHEN text IS NULL THEN 'no tab' WHEN query_id = '' OR text = '' THEN 'nothing on one side of the tab' END AS problem FROM parsed)"""
_RULES = """
used AS (SELECT query_id, passage_id, relevance, length(query) AS q, CAST(length(passage) >> k AS INTEGER) AS n, k FROM (SELECT *, CAST(list_min(list_filter(range(0, 40), lambda s: (length(passage) >> s) <= 1000)) AS INTEGER) AS k FROM inputs)),
outcomes AS (SELECT *, n % 11 IN (3, 4, 5) AS failed, CASE n % 11 WHEN 3 THEN 'lost after 4 repeats' WHEN 4 THEN 'quota' WHEN 5 THEN 'no complete answer: incomplete' END AS error, CASE n % 11 WHEN 3 THEN 'RequestFailed' WHEN 4 THEN 'RequestFailed' WHEN 5 THEN 'ValueError' END AS type,
  CASE n % 11 WHEN 1 THEN 1 WHEN 2 THEN 4 ELSE 0 END AS repeats FROM used)"""
_SECONDS = "CASE WHEN abs({0}) < CAST('inf' AS DOUBLE) THEN {0} ELSE 0 END"
_RETRIES = f"""
sent AS (SELECT event_id, CAST(event_id % 10 AS INTEGER) AS attempt, [429, 429, NULL, 408, 503, 400, 409][event_id % 7 + 1] AS status, ['insufficient_quota', '{PASSING}', '{PASSING}'][event_id % 3 + 1] AS code,
  CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 90000 AS DOUBLE) / 1000 ELSE 0 END AS ms, CASE WHEN event_id % 4 = 1 THEN coalesce(try_cast(['7', 'soon', 'nan', 'inf', '0.25', '70'][event_id % 6 + 1] AS DOUBLE), 0) ELSE 0 END AS s,
  CASE event_id % 6 WHEN 2 THEN event_id % 70 + CAST(0.5 AS DOUBLE) WHEN 3 THEN CAST(event_id AS DOUBLE) / 1000 ELSE 0 END AS said FROM events),
kinds AS (SELECT *, CASE WHEN status = 429 THEN CASE WHEN code = '{PASSING}' THEN 8 ELSE 0 END WHEN status IS NULL OR status IN (408, 409) OR status >= 500 THEN 4 ELSE 0 END AS most FROM sent),
plans AS (SELECT *, attempt < most AS again, greatest(least(60, pow(CAST(2 AS DOUBLE), attempt)), ms, {_SECONDS.format("s")}, said) AS wait FROM kinds)"""


def _leaf(name: str, value: str, source: str) -> str:
    return f"SELECT {name} AS name, round(CAST({value} AS DOUBLE), 6) AS value FROM {source}"


_USAGE = f"""
used_ AS (SELECT i AS input_tokens, o AS output_tokens, i + o AS total_tokens, w AS judgments_with_usage, n - w AS judgments_without_usage, i * CAST({prompts.PRICES["gpt-6-luna"][0]} AS DOUBLE) / 1000000 AS input, o * CAST({prompts.PRICES["gpt-6-luna"][1]} AS DOUBLE) / 1000000 AS output
  FROM (SELECT coalesce(sum(input_tokens) FILTER (output_tokens IS NOT NULL), 0) AS i, coalesce(sum(output_tokens) FILTER (input_tokens IS NOT NULL), 0) AS o, count(*) FILTER (input_tokens IS NOT NULL AND output_tokens IS NOT NULL) AS w, count(*) AS n FROM fx_judgments))"""
_AGREE = {"count": "c", "agree_count": "a", "exact_agreement": "CAST(a AS DOUBLE) / c", "cohen_kappa": "(CAST(a AS DOUBLE) / c - CAST(e AS DOUBLE) / (c * c)) / (1 - CAST(e AS DOUBLE) / (c * c))"}
_COST = {"input": "input", "output": "output", "total": "input + output", "token_costs_per_million.input": str(prompts.PRICES["gpt-6-luna"][0]), "token_costs_per_million.output": str(prompts.PRICES["gpt-6-luna"][1])}
_CORRELATION = {"tau_b": "difference / sqrt(prod)", "system_count": "n", "p_value": "sqrt(2 / pi()) * exp(-z * z / 2) * area"}
#: Every number of the report by its path.
_REPORT = [
    _leaf("'agreement.labels.' || g", "g", "range(4) AS t(g)"), _leaf("'agreement.counts.' || human_relevance || '.' || predicted_relevance", "n", "cells"),
    _leaf("'agreement.human_support.' || g", "n", "hs"), _leaf("'agreement.method_support.' || g", "n", "ps"), *[_leaf(f"'agreement.{k}'", v, "one, chance") for k, v in _AGREE.items()],
    *[_leaf(f"'system_rank_correlations.' || metric || '.{k}'", v, "areas") for k, v in _CORRELATION.items()], *[_leaf(f"'cost.{k}'", v, "used_") for k, v in _COST.items()],
    *[_leaf(f"'usage.{k}'", k, "used_") for k in ("input_tokens", "output_tokens", "total_tokens", "judgments_with_usage", "judgments_without_usage")],
    _leaf("'judgment_count'", "count(*)", "fx_judgments"), _leaf("'query_count'", "count(DISTINCT query_id)", "fx_judgments"), f"SELECT 'evaluation.binary_relevance_threshold', CAST({RELEVANT} AS DOUBLE)",
]


def _with(body: str, *parts: str) -> str:
    return f"WITH {','.join([SQL, *parts])}\n{body}"


def _paced(key: str) -> str:
    """A request costs a 450th or its tokens' 180,000ths of a minute, in microseconds: 133,333, or 333 a token."""
    return f"""WITH costs AS (SELECT event_id, user_id, epoch_us(ts) AS t, greatest(133333, (200 + event_id % 400) * 333) AS cost FROM events),
        befores AS (SELECT *, coalesce(sum(cost) OVER ({key} ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM costs),
        starts AS (SELECT *, CAST(b + max(t - b) OVER ({key} ORDER BY t, event_id) AS BIGINT) AS start FROM befores)
        SELECT event_id, user_id, start, CAST(start - t AS BIGINT) AS delay FROM starts"""


def oracle_sql() -> dict[str, str]:
    pair = "query_id, passage_id"
    rate = prompts.PRICES["gpt-6-luna"]
    return {
        "run_metrics_aggregate": _with("SELECT run, source, max(value) FILTER (metric = 'nDCG@10') AS ndcg10, max(value) FILTER (metric = 'nDCG@100') AS ndcg100, max(value) FILTER (metric = 'AP(rel=2)') AS ap2 FROM means GROUP BY ALL", _METRICS),
        "run_metrics_per_query": _with("SELECT run, source, query_id, metric, round(value, 6) AS value FROM per_query", _METRICS),
        "ranked_top10": _with("SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY run, query_id ORDER BY score DESC, passage_id DESC) AS INTEGER) AS rank FROM fx_runs) WHERE rank <= 10"),
        "rank_correlation": _with(f"""SELECT metric, n AS system_count, difference, CAST(n1 AS BIGINT) AS tied_human, CAST(n2 AS BIGINT) AS tied_predicted, round(CASE WHEN prod > 0 THEN difference / sqrt(prod) END, 6) AS tau_b,
            round(CASE WHEN prod > 0 AND var > 0 THEN difference / sqrt(var) END, 6) AS z, CASE WHEN prod <= 0 THEN '{CONSTANT}' END AS undefined_reason FROM taus""", _METRICS, _TAU),
        "system_score_bounds": _with("SELECT metric, least(min(h), min(p)) AS low, greatest(max(h), max(p)) AS high FROM paired GROUP BY metric", _METRICS),
        "agreement_confusion": _with("SELECT * FROM cells", _CONFUSION),
        "agreement_confusion_normalized": _with("SELECT *, round(CASE WHEN sum(n) OVER (PARTITION BY human_relevance) > 0 THEN CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY human_relevance) ELSE 0 END, 6) AS share FROM cells", _CONFUSION),
        "agreement_summary": _with(f"""SELECT c AS count, a AS agree_count, round(CAST(a AS DOUBLE) / c, 6) AS exact_agreement, round(CAST(e AS DOUBLE) / (c * c), 6) AS chance_agreement,
            round(CASE WHEN e < c * c THEN (CAST(a AS DOUBLE) / c - CAST(e AS DOUBLE) / (c * c)) / (1 - CAST(e AS DOUBLE) / (c * c)) END, 6) AS cohen_kappa, CASE WHEN e = c * c THEN '{NO_VARIATION}' END AS undefined_reason,
            (SELECT string_agg(CAST(CAST(n AS BIGINT) AS VARCHAR), ',' ORDER BY g) FROM hs) AS human_support, (SELECT string_agg(CAST(CAST(n AS BIGINT) AS VARCHAR), ',' ORDER BY g) FROM ps) AS method_support FROM one, chance""", _CONFUSION, _SUMMARY),
        "collection_summary": _with(f"""SELECT (SELECT count(*) FROM fx_queries) AS number_of_queries, (SELECT count(*) FROM fx_passages) AS number_of_passages, (SELECT count(*) FROM fx_qrels) AS number_of_judgments,
            (SELECT round(avg(len({_WORDS.format("text")})), 6) FROM fx_queries) AS words_average, (SELECT min(len({_WORDS.format("text")})) FROM fx_queries) AS words_minimum, (SELECT max(len({_WORDS.format("text")})) FROM fx_queries) AS words_maximum,
            (SELECT round(avg(n), 6) FROM (SELECT count(r.query_id) AS n FROM fx_queries q LEFT JOIN fx_qrels r USING (query_id) GROUP BY q.query_id)) AS average_judged_passages_per_query"""),
        "grade_distribution": _with("SELECT CAST(g AS INTEGER) AS relevance, count(query_id) AS judgments, round(CAST(count(query_id) AS DOUBLE) / (SELECT count(*) FROM fx_queries), 6) AS average FROM range(4) AS t(g) LEFT JOIN fx_qrels ON relevance = g GROUP BY g"),
        "judgments_per_query": _with("SELECT q.query_id, count(r.passage_id) AS judgments FROM fx_queries q LEFT JOIN fx_qrels r USING (query_id) GROUP BY q.query_id"),
        "pending_judgments": _with(f"SELECT * FROM fx_qrels WHERE ({pair}) NOT IN (SELECT ({pair}) FROM fx_checkpoint)"),
        "refreshed_judgments": _with("SELECT c.query_id, c.passage_id, q.relevance AS human_relevance, c.predicted_relevance FROM fx_checkpoint c JOIN fx_qrels q USING (query_id, passage_id)"),
        "judged_queries": _with("SELECT * FROM fx_queries WHERE query_id IN (SELECT query_id FROM fx_qrels)"),
        "required_passages": _with("SELECT * FROM fx_passages WHERE passage_id IN (SELECT passage_id FROM fx_qrels)"),
        "orphan_references": _with(f"SELECT {pair}, 'query' AS missing FROM fx_dirty WHERE query_id NOT IN (SELECT query_id FROM fx_queries) UNION ALL SELECT {pair}, 'passage' FROM fx_dirty WHERE passage_id NOT IN (SELECT passage_id FROM fx_passages)"),
        "duplicate_pairs": _with(f"SELECT {pair}, count(*) AS n FROM fx_dirty GROUP BY ALL HAVING count(*) > 1"),
        "invalid_grades": _with("SELECT * FROM fx_dirty WHERE relevance NOT BETWEEN 0 AND 3"),
        "checkpoint_difference": _with(f"SELECT DISTINCT {pair}, 'qrels' AS only_in FROM fx_dirty WHERE ({pair}) NOT IN (SELECT ({pair}) FROM fx_checkpoint) UNION ALL SELECT DISTINCT {pair}, 'checkpoint' FROM fx_checkpoint WHERE ({pair}) NOT IN (SELECT ({pair}) FROM fx_dirty)"),
        "passage_truncation": _with(f"SELECT {pair}, CAST(length(whole) AS INTEGER) AS passage_original_chars, CAST(length(passage) AS INTEGER) AS passage_used_chars, length(passage) < length(whole) AS passage_truncated, md5(passage) AS digest FROM inputs", _inputs(BUDGET)),
        "token_estimates": _with(f"SELECT {pair}, CAST(ceil(CAST({prompts.PROMPT_BYTES} + octet_length(encode(query)) + octet_length(encode(passage)) + {_ESC.format('query')} + {_ESC.format('passage')} AS DOUBLE) / 3) + 128 AS BIGINT) AS tokens FROM inputs", _inputs(prompts.CHARACTER_BUDGET)),
        "argmax_grades": _with(f"SELECT {pair}, CAST(list_position(probabilities, list_max(probabilities)) - 1 AS INTEGER) AS grade, list_max(probabilities) AS best FROM fx_judgments"),
        "usage_and_cost": _with(f"""SELECT CAST(i AS BIGINT) AS input_tokens, CAST(o AS BIGINT) AS output_tokens, CAST(i + o AS BIGINT) AS total_tokens, w AS judgments_with_usage, n - w AS judgments_without_usage, round(i * CAST({rate[0]} AS DOUBLE) / 1000000, 6) AS input_cost,
            round(o * CAST({rate[1]} AS DOUBLE) / 1000000, 6) AS output_cost, round(i * CAST({rate[0]} AS DOUBLE) / 1000000 + o * CAST({rate[1]} AS DOUBLE) / 1000000, 6) AS total_cost, n = w AS complete, CAST(NULL AS VARCHAR) AS undefined_reason
            FROM (SELECT coalesce(sum(input_tokens) FILTER (output_tokens IS NOT NULL), 0) AS i, coalesce(sum(output_tokens) FILTER (input_tokens IS NOT NULL), 0) AS o, count(*) FILTER (input_tokens IS NOT NULL AND output_tokens IS NOT NULL) AS w, count(*) AS n FROM fx_judgments)"""),
        "union_of_sources": _with(f"SELECT {pair}, 'human' AS source, human_relevance AS relevance, CAST(NULL AS DOUBLE) AS input_tokens FROM fx_judgments UNION ALL SELECT {pair}, 'method', predicted_relevance, CAST(input_tokens AS DOUBLE) FROM fx_judgments"),
        "rate_limit_schedule": _paced("PARTITION BY user_id"),
        "rate_limit_shared": _paced(""),
        "parse_run_lines": _with(f"""SELECT run, f[1] AS query_id, f[3] AS passage_id, {_FINITE.format("f[5]")} AS score,
            CASE WHEN len(f) <> 6 THEN 'expected six columns' WHEN NOT starts_with(f[3], 'msmarco_passage_') OR coalesce({_WHOLE.format("f[4]")} < 0, true) THEN 'invalid passage or rank' WHEN ({_FINITE.format("f[5]")}) IS NULL THEN 'invalid score' END AS problem
            FROM (SELECT run, {_WORDS.format("line")} AS f FROM fx_run_lines) WHERE len(f) > 0"""),
        "parse_qrel_lines": _with(f"""SELECT f[1] AS query_id, f[3] AS passage_id, CAST({_WHOLE.format("f[4]")} AS DOUBLE) AS relevance,
            CASE WHEN len(f) <> 4 THEN 'expected four columns' WHEN coalesce(({_WHOLE.format("f[4]")}) NOT BETWEEN 0 AND 3, true) OR NOT regexp_full_match(f[3], 'msmarco_passage_[0-9]+_[0-9]+') THEN 'invalid judgment' END AS problem
            FROM (SELECT {_WORDS.format("line")} AS f FROM fx_qrel_lines) WHERE len(f) > 0"""),
        "judge_stub": _with(f"""SELECT {pair}, CAST(CASE WHEN ok THEN relevance END AS DOUBLE) AS human_relevance, CAST(CASE WHEN ok THEN used END AS DOUBLE) AS passage_used_chars, CAST(CASE WHEN ok THEN k END AS DOUBLE) AS length_retries,
            CAST(CASE WHEN ok THEN (length(query) * 3 + used) % 4 END AS DOUBLE) AS predicted_relevance, CAST(CASE WHEN ok THEN length(query) + used END AS DOUBLE) AS input_tokens, CASE WHEN NOT ok THEN 'refused' END AS error, CASE WHEN NOT ok THEN 'ValueError' END AS type
            FROM (SELECT *, CAST(length(passage) >> k AS INTEGER) AS used, (length(passage) >> k) % 97 <> 5 AS ok FROM (SELECT *, CAST(list_min(list_filter(range(0, 40), lambda s: (length(passage) >> s) <= 1000)) AS INTEGER) AS k FROM inputs))""", _inputs(prompts.CHARACTER_BUDGET)),
        "rank_correlation_pvalue": _with("SELECT metric, n AS system_count, round(difference / sqrt(prod), 6) AS tau_b, round((ln(sqrt(CAST(2 AS DOUBLE) / pi())) - z * z / 2 + ln(area)) / ln(CAST(10 AS DOUBLE)), 6) AS log10_p FROM areas", _METRICS, _TAU, _AREA),
        "run_files": f"""SELECT path, list_last(string_split(path, '/')) AS run FROM (SELECT 'runs/' || source || '/r' || doc_id || {_LIST(SUFFIXES)}[doc_id % {len(SUFFIXES)} + 1] AS path FROM documents)
            WHERE regexp_extract(path, '[^/](\\.[^./]*)$', 1) IN ('.gz', '.txt', '.trec', '.run')""",
        "parse_judgment_lines": _with(f"""SELECT query_id, passage_id, CAST(human_relevance AS DOUBLE) AS human_relevance, CAST(predicted_relevance AS DOUBLE) AS predicted_relevance, CAST(output_tokens AS DOUBLE) AS output_tokens, CAST(NULL AS VARCHAR) AS line, CAST(NULL AS VARCHAR) AS problem FROM fx_judgments
            UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, line, 'not of the schema' FROM (SELECT unnest({_LIST(BAD_JUDGMENT_LINES[:5])}) AS line) UNION ALL VALUES ('1', 'a', 1, 2, NULL, NULL, NULL)"""),
        "parse_query_lines": _with("SELECT query_id, text, problem FROM queries_", _RECORDS),
        "conflicting_queries": _with("SELECT query_id, count(*) AS n FROM (SELECT DISTINCT query_id, text FROM queries_ WHERE problem IS NULL) GROUP BY query_id HAVING count(*) > 1", _RECORDS),
        "published_collection": _with("""SELECT 'queries' AS "table", query_id AS key, md5(text) AS digest FROM fx_queries UNION ALL SELECT 'passages', passage_id, md5(concat_ws(' ', text, document_id, spans)) FROM fx_passages
            UNION ALL SELECT 'qrels', query_id || ' ' || passage_id, md5(CAST(relevance AS VARCHAR)) FROM fx_qrels"""),
        "corpus_passages": _with("SELECT passage_id, text, document_id, '(0,1)' AS spans, CAST(place AS BIGINT) AS offset, false AS misplaced, 2 AS shards_read FROM shards JOIN wanted ON doc_id = d WHERE doc_id % 97 <> 5 UNION ALL SELECT passage_id, text, document_id, '(0,1)', CAST(place AS BIGINT), true, 2 FROM shards JOIN wanted ON doc_id = d WHERE doc_id % 97 = 5", _SHARD),
        "corpus_passages_by_offset": _with("""SELECT passage_id, substr(passage_id, 1, 18) AS run, CASE WHEN fits THEN text END AS text, CASE WHEN fits THEN document_id END AS document_id, CASE WHEN fits THEN '(0,1)' END AS spans, CAST(place + CASE WHEN fits THEN 0 ELSE 1 END AS BIGINT) AS offset
            FROM (SELECT *, doc_id % 97 <> 5 AS fits FROM shards JOIN wanted ON doc_id = d)""", _SHARD),
        "built_collection": _with("""SELECT 'queries' AS "table", query_id AS key, md5(regexp_replace(text, '[\\x00-\\x1f\\x{85}\\x{2028}\\x{2029}]', ' ', 'g')) AS digest FROM fx_queries WHERE query_id IN (SELECT query_id FROM judged)
            UNION ALL SELECT 'passages', passage_id, md5(text || ' ' || document_id || ' (0,1)') FROM shards WHERE passage_id IN (SELECT passage_id FROM judged)
            UNION ALL SELECT 'qrels', query_id || ' ' || passage_id, md5(CAST(relevance AS VARCHAR)) FROM judged""", _SHARD, _SHARD_QRELS),
        "qrels_in_order": _with("SELECT query_id, passage_id, CAST(relevance AS DOUBLE) AS relevance, row_number() OVER (ORDER BY md5(query_id || ' ' || passage_id) || query_id || ' ' || passage_id) - 1 AS position FROM judged", _SHARD, _SHARD_QRELS),
        "missing_passages": _with("SELECT DISTINCT passage_id FROM (SELECT passage_id FROM fx_dirty UNION ALL SELECT passage_id FROM shards JOIN wanted ON doc_id = d) WHERE passage_id NOT IN (SELECT passage_id FROM fx_passages) ORDER BY passage_id LIMIT 10", _SHARD),
        "unknown_queries": _with("SELECT DISTINCT query_id FROM fx_dirty WHERE query_id NOT IN (SELECT query_id FROM fx_queries)"),
        "collection_violations": _with(f"""SELECT 'query id repeats' AS rule, query_id AS at FROM fx_queries WHERE query_id IN ('1', '7') UNION ALL SELECT 'pair repeats', query_id || ' ' || passage_id FROM fx_dirty GROUP BY {pair} HAVING count(*) > 1
            UNION ALL SELECT 'query of a pair is unknown', query_id || ' ' || passage_id FROM fx_dirty WHERE query_id NOT IN (SELECT query_id FROM fx_queries) UNION ALL SELECT 'passage of a pair is unknown', query_id || ' ' || passage_id FROM fx_dirty WHERE passage_id NOT IN (SELECT passage_id FROM fx_passages)
            UNION ALL SELECT 'grade outside the domain', query_id || ' ' || passage_id FROM fx_dirty WHERE relevance NOT BETWEEN 0 AND 3 UNION ALL SELECT 'query is never judged', query_id FROM (SELECT query_id FROM fx_queries UNION ALL SELECT query_id FROM fx_queries WHERE query_id IN ('1', '7')) WHERE query_id NOT IN (SELECT query_id FROM fx_dirty)
            UNION ALL SELECT 'passage is never judged', passage_id FROM fx_passages WHERE passage_id NOT IN (SELECT passage_id FROM fx_dirty)"""),
        "summary_report": _with(f"""SELECT CAST(1 AS INTEGER) AS line, format('Number of queries: {{:,}}', count(*)) AS text FROM fx_queries UNION ALL SELECT 2, format('Number of unique passages: {{:,}}', count(*)) FROM fx_passages UNION ALL SELECT 3, format('Number of judgments: {{:,}}', count(*)) FROM fx_qrels
            UNION ALL SELECT 4, printf('Average query length (words): %.2f', avg(len({_WORDS.format("text")}))) FROM fx_queries UNION ALL SELECT 5, 'Minimum query length (words): ' || min(len({_WORDS.format("text")})) FROM fx_queries UNION ALL SELECT 6, 'Maximum query length (words): ' || max(len({_WORDS.format("text")})) FROM fx_queries
            UNION ALL SELECT 7, printf('Average judged passages per query: %.2f', (SELECT count(*) FROM fx_qrels) / (SELECT count(*) FROM fx_queries)) UNION ALL SELECT 8, '' UNION ALL SELECT 9, 'Relevance grade | Judgments | Average judged passages per query'
            UNION ALL SELECT CAST(10 + g AS INTEGER), lpad(CAST(g AS VARCHAR), 15, ' ') || ' | ' || lpad(format('{{:,}}', n), 9, ' ') || ' | ' || printf('%.2f', n / (SELECT count(*) FROM fx_queries)) FROM (SELECT g, count(query_id) AS n FROM range(4) AS t(g) LEFT JOIN fx_qrels ON relevance = g GROUP BY g)"""),
        "figure_points": _with("SELECT 'system_scores_' || regexp_replace(metric, '[^a-zA-Z0-9]', '_', 'g') AS figure, run, round(h, 6) AS human, round(p, 6) AS predicted FROM paired", _METRICS),
        "judge_prompt": _with(f"SELECT query_id, CAST(i - 1 AS INTEGER) AS place, l[i] AS line, CAST(530 + length(text) + {_ESC.format('text')} AS INTEGER) AS request_chars FROM fx_queries, (SELECT {_LIST([prompts.INSTRUCTIONS, *(f'[{g}] {c}' for g, c in enumerate(prompts.CRITERIA))])} AS l), range(1, {len(prompts.CRITERIA) + 2}) AS t(i)"),
        "structured_answers": _with(f"""SELECT {pair}, CAST(nullif(regexp_extract(answer, '^\\s*\\{{\\s*"grade"\\s*:\\s*([0-3])\\s*\\}}\\s*$', 1), '') AS DOUBLE) AS grade FROM (
            SELECT {pair}, {_LIST([a for a, _ in ANSWERS])}[k] || predicted_relevance || {_LIST([b for _, b in ANSWERS])}[k] AS answer FROM (SELECT *, CAST(substr(passage_id, {len(PREFIX) + 1}) AS BIGINT) % {len(ANSWERS)} + 1 AS k FROM fx_judgments))"""),
        "experiment_guard": _with(f"""SELECT query_id, CASE WHEN done IS NULL THEN NULL WHEN i % 3 = 0 THEN 'The folder has judgments, but not what they were made with' WHEN i % 3 = 1 AND done <> every THEN 'The folder''s judgments are of another experiment: other texts, model or configuration' END AS problem
            FROM (SELECT query_id, CAST(query_id AS BIGINT) AS i, string_agg(passage_id || ':' || predicted_relevance, ',' ORDER BY passage_id || ':' || predicted_relevance) AS every FROM fx_judgments GROUP BY ALL)
            LEFT JOIN (SELECT query_id, string_agg(passage_id || ':' || predicted_relevance, ',' ORDER BY passage_id || ':' || predicted_relevance) AS done FROM fx_checkpoint WHERE query_id NOT LIKE '%7' GROUP BY ALL) USING (query_id)"""),
        "judge_probabilistic": _with(f"""SELECT {pair}, CAST(list_position(w, list_max(w)) - 1 AS DOUBLE) AS predicted_relevance, w[2] + 2 * w[3] + 3 * w[4] AS score, list_max(w) AS confidence, 'weighing' AS model, CAST(g AS VARCHAR) AS grade, w[g + 1] AS probability
            FROM (SELECT {pair}, list_transform(range(4), lambda g: ((length(query) * (g + 3) + length(passage) * 7) % 8) / CAST(8 AS DOUBLE)) AS w FROM inputs), range(4) AS t(g)""", _inputs(prompts.CHARACTER_BUDGET)),
        "judge_run": _with(f"""SELECT {pair}, CAST(CASE WHEN NOT failed THEN relevance END AS DOUBLE) AS human_relevance, CAST(CASE WHEN NOT failed THEN (q + n) % 4 END AS DOUBLE) AS predicted_relevance, CAST(CASE WHEN NOT failed THEN n END AS DOUBLE) AS passage_used_chars, CAST(CASE WHEN NOT failed THEN k END AS DOUBLE) AS length_retries,
            CAST(CASE WHEN NOT failed THEN repeats END AS DOUBLE) AS repeats, NOT failed AS timed, error, type, (SELECT count(*) FROM outcomes WHERE failed) AS failures FROM outcomes""", _inputs(prompts.CHARACTER_BUDGET), _RULES),
        "judge_resumed": _with(f"""SELECT {pair}, CAST(relevance AS DOUBLE) AS human_relevance, CAST(CASE WHEN length(passage) % 3 <> 0 THEN length(passage) % 4 ELSE (length(query) + length(passage)) % 4 END AS DOUBLE) AS predicted_relevance,
            CASE WHEN length(passage) % 3 <> 0 THEN 'first' ELSE 'second' END AS model FROM inputs""", _inputs(prompts.CHARACTER_BUDGET)),
        "deferred_requests": _with(f"""SELECT {pair}, CAST(t AS DOUBLE) AS attempts, CAST(t AS DOUBLE) AS rounds, true AS timed FROM (SELECT *, CASE n % 11 WHEN 1 THEN 1 WHEN 2 THEN 4 WHEN 3 THEN 4 END AS t FROM used) WHERE t IS NOT NULL""", _inputs(prompts.CHARACTER_BUDGET), _RULES),
        "equal_tables": _with("""SELECT 'qrels again' AS tables, true AS same, count(*) AS left_rows, count(*) AS right_rows FROM fx_qrels UNION ALL SELECT 'dirty and qrels', false, (SELECT count(*) FROM fx_dirty), count(*) FROM fx_qrels
            UNION ALL SELECT 'dirty and one with repeats', (SELECT count(*) FROM (FROM fx_dirty EXCEPT ALL FROM again)) + (SELECT count(*) FROM (FROM again EXCEPT ALL FROM fx_dirty)) = 0, (SELECT count(*) FROM fx_dirty), (SELECT count(*) FROM again)
            UNION ALL SELECT 'no labels of a query', count(*) FILTER (query_id = '1') = 0, count(*), count(*) FROM fx_qrels UNION ALL SELECT 'passages again', true, count(*), count(*) FROM fx_passages""",
            "again AS (SELECT * FROM fx_dirty WHERE query_id <> '3' UNION ALL SELECT * FROM fx_dirty WHERE query_id = '2')"),
        "ordered_fingerprint": _with("""SELECT name, CASE WHEN n <= 256 THEN d1 WHEN n <= 65536 THEN d2 ELSE d3 END AS sha256 FROM (SELECT name, max(n) AS n, any_value(d1) AS d1 FROM first GROUP BY name) JOIN (SELECT name, any_value(d2) AS d2 FROM second GROUP BY name) USING (name)
            JOIN (SELECT name, sha256(string_agg(d2, '' ORDER BY i)) AS d3 FROM second GROUP BY name) USING (name)""",
            """leaves AS (SELECT *, sha256(length(query_id) || ':' || query_id || length(passage_id) || ':' || passage_id || '1:' || relevance) AS d FROM fx_qrels),
            placed AS (SELECT 'by id' AS name, d, row_number() OVER (ORDER BY query_id, passage_id) - 1 AS i FROM leaves UNION ALL SELECT 'backwards', d, row_number() OVER (ORDER BY CAST(query_id AS BIGINT) DESC, CAST(substr(passage_id, 20) AS BIGINT) DESC) - 1 FROM leaves),
            first AS (SELECT name, i // 256 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d1, sum(count(*)) OVER (PARTITION BY name) AS n FROM placed GROUP BY name, i // 256),
            second AS (SELECT name, i // 256 AS i, sha256(string_agg(d1, '' ORDER BY i)) AS d2 FROM first GROUP BY name, i // 256)"""),
        "retry_schedule": f"WITH {_RETRIES} SELECT event_id, again, round(CASE WHEN again OR status = 429 AND most = 8 THEN wait END, 6) AS delay FROM plans",
        "run_manifest": _with("SELECT run || '.run' AS file, sha256(string_agg(concat_ws(' ', query_id, 'Q0', passage_id, '1', CAST(CAST(score AS DECIMAL(12, 6)) AS VARCHAR), run), chr(10) ORDER BY query_id, passage_id) || chr(10)) AS sha256 FROM fx_runs GROUP BY run"),
        "report_numbers": _with(" UNION ALL ".join(_REPORT), _METRICS, _TAU, _AREA, _CONFUSION, _SUMMARY, _USAGE),
        "not_finite": _with(f"SELECT run, {pair} FROM fx_runs WHERE (CAST(substr(passage_id, {len(PREFIX) + 1}) AS BIGINT) * 7 + CAST(substr(run, 2) AS INTEGER)) % 50 IN (0, 1)"),
    }
