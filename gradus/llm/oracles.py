"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from gradus.llm import licences, queries, urls

_REST = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
_FITS = [(k, r, "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')".format(*r.split("/", 1))) for k, r in sorted(queries.RULES, key=lambda x: (-len(x[1]), x[1]))]
_DIFFERS = "pow(CAST(b AS DOUBLE) * {0}_l - CAST(l AS DOUBLE) * {0}_b, 2) > CAST({similar} AS DOUBLE) * l * {0}_b * ({0}_l - {0}_b)"
_LEVEL = """
c{0} AS (SELECT host, template, shape[{0}] AS child, sum(n) AS n, sum(labelled) AS l, sum(bad) AS b FROM t{1} WHERE len(shape) >= {0} GROUP BY ALL),
m{0} AS (SELECT host, template, count(*) AS k, sum(n) AS all_n, sum(CASE WHEN l >= {support} THEN l ELSE 0 END) AS strong_l, sum(CASE WHEN l >= {support} THEN b ELSE 0 END) AS strong_b, sum(l) AS node_l, sum(b) AS node_b FROM c{0} GROUP BY ALL),
j{0} AS (SELECT host, template, child, k > {fan} AND NOT (n * {fan} >= all_n AND n * k > all_n * {per}) AND NOT (l >= {support} AND {of_node}) AS variable, l >= {support} AND NOT ({of_strong}) AS alike FROM c{0} JOIN m{0} USING (host, template)),
w{0} AS (SELECT host, template, child, variable OR (alike AND count(*) FILTER (alike) OVER (PARTITION BY host, template) > 1) AS wild FROM j{0}),
t{0} AS (SELECT t.host, t.shape, t.n, t.labelled, t.bad, CASE WHEN len(t.shape) >= {0} THEN t.template || '/' || CASE WHEN wild THEN '*' ELSE w.child END ELSE t.template END AS template
  FROM t{1} t LEFT JOIN w{0} w ON w.host = t.host AND w.template = t.template AND w.child = t.shape[{0}])"""
_OF = {f"of_{x}": _DIFFERS.format(x, similar=urls.SIMILAR) for x in ("node", "strong")}
URLS = f"""
WITH cut AS (SELECT page_id, {_REST} AS rest FROM pages),
own AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, CASE {" ".join(f"WHEN {f} THEN '{r}'" for _, r, f in _FITS)} END AS rule, CASE {" ".join(f"WHEN {f} THEN '{k}'" for k, _, f in _FITS)} END AS ruled,
  list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_full_match(s, '[0-9a-fA-F]{{8,}}') THEN '<hex>' ELSE regexp_replace(s, '[0-9]+', '<n>', 'g') END) AS shape FROM own),
marked AS (SELECT host, shape, 1 AS n, CASE WHEN ruled IS NOT NULL THEN 1 ELSE 0 END AS labelled, CASE WHEN ruled = 'block' THEN 1 ELSE 0 END AS bad FROM ruled
  UNION ALL SELECT host, shape, 0, 1, CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END FROM ruled JOIN labels ON doc_id = try_cast(regexp_extract(path, '{queries.DOCUMENT}', 1) AS BIGINT) WHERE ruled IS NULL),
t0 AS (SELECT host, shape, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad, '' AS template FROM marked GROUP BY host, shape),
{",".join(_LEVEL.format(i, i - 1, support=urls.SUPPORT, fan=urls.FAN_OUT, per=urls.PER_CHILD, **_OF) for i in range(1, urls.DEPTH + 1))},
whole AS (SELECT host, shape, labelled, bad, CASE WHEN len(shape) > {urls.DEPTH} THEN template || '/**' ELSE template END AS template FROM t{urls.DEPTH}),
sums AS (SELECT host, template, CAST(sum(labelled) AS BIGINT) AS n_labelled, CAST(sum(bad) AS BIGINT) AS n_bad FROM whole GROUP BY ALL)
SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN n_labelled >= {urls.SUPPORT} AND CAST(n_bad AS DOUBLE) + 1 >= CAST({urls.IMPURE} AS DOUBLE) * (n_labelled + 2) THEN 'block' ELSE 'allow' END) AS verdict,
  w.template, n_labelled, n_bad
FROM ruled r LEFT JOIN whole w ON w.host = r.host AND w.shape = r.shape LEFT JOIN sums s ON s.host = w.host AND s.template = w.template"""

_WEIGHT = "CASE " + " ".join(f"WHEN source = '{k}' THEN CAST({v} AS DOUBLE)" for k, v in queries.WEIGHTS.items()) + " ELSE CAST(1 AS DOUBLE) END"
MIXING = f"""
WITH sums AS (SELECT source, sum(coalesce(length(text), 0)) AS chars, {_WEIGHT} AS weight FROM documents GROUP BY source),
whole AS (SELECT CAST(sum(chars) AS DOUBLE) AS all_chars, sum(weight) AS all_weight FROM sums WHERE chars > 0),
rates AS (SELECT source, CASE WHEN chars > 0 THEN weight / all_weight * all_chars / CAST(chars AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS rate FROM sums, whole),
steps AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM rates WHERE rate > 0),
logs AS (SELECT source, k, -rate + sum(CASE WHEN k = 0 THEN 0 ELSE ln(rate / greatest(k, 1)) END) OVER (PARTITION BY source ORDER BY k) AS l FROM steps),
cdf AS (SELECT source, k, sum(exp(l)) OVER (PARTITION BY source ORDER BY k) AS c FROM logs),
cdfs AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
drawn AS (SELECT d.*, len(list_filter(cs, lambda c: c <= CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0)) AS n
  FROM documents d JOIN cdfs ON d.source IS NOT DISTINCT FROM cdfs.source)
SELECT * EXCLUDE (n), CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy_no FROM drawn WHERE n > 0"""

_TURN = r"replace(replace({}, '\', '\\'), '<|', '<\|')"
CHAT = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|><|im_sep|><|im_end|>') + length({_TURN.format("role")}) + length({_TURN.format("text")})) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id"""


def _canonical(text: str) -> str:
    out = f"lower({text})"
    for pattern in (licences.HOLDER, licences.RESERVED):
        out = f"regexp_replace({out}, '{pattern}', '', 'g')"
    out = f"(' ' || regexp_replace({out}, '[^a-z0-9]+', '  ', 'g') || ' ')"
    for old, new in licences.EQUIVALENT:
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


_KNOWN = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licences.LICENCES.items())
LICENCES = f"""
WITH known AS (SELECT licence, sha256({_canonical("body")}) AS d FROM (VALUES {_KNOWN}) AS t(licence, body)),
own AS (SELECT doc_id, text, sha256({_canonical("text")}) AS digest FROM documents),
lines AS (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS line FROM documents),
found AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS ids FROM lines JOIN known ON sha256({_canonical("line")}) = d
  WHERE contains(line, '{licences.LINE_MARK}') AND licence LIKE '%-notice' GROUP BY doc_id)
SELECT own.doc_id, digest, k.licence, coalesce(n, 0) AS n_notices, coalesce(ids, '') AS notices
FROM own LEFT JOIN known k ON k.d = digest LEFT JOIN found ON found.doc_id = own.doc_id"""

_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all(" + _AZ + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM.format("text")} AS w FROM benchmark),
tests AS (SELECT DISTINCT item, list_aggregate(w[k:k + 9], 'string_agg', ' ') AS phrase, len(w[k:k + 9]) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS k FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_ALNUM.format("coalesce(text, '')")} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM tests),
runs AS (SELECT doc_id, k, n, list_aggregate(w[k:k + n - 1], 'string_agg', ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS k FROM docs, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, k, runs.n, item FROM runs JOIN tests USING (phrase)),
words AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS word FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)"""

_WORD = r"'[^\x20\x09-\x0D]+'"
JACCARD = f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, {_WORD}) AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM docs)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes nx ON nx.doc_id = x JOIN sizes ny ON ny.doc_id = y WHERE 100 * o >= 85 * (nx.n + ny.n - o)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT x AS doc_id, x AS c FROM edges UNION SELECT y, c FROM reached JOIN edges ON x = doc_id),
named AS (SELECT doc_id, min(c) AS c FROM reached GROUP BY doc_id)
SELECT docs.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, docs.doc_id) AS component_id FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN named USING (doc_id)"""

PASSAGES = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
runs AS (SELECT doc_id, k, array_to_string(w[k:k + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS k FROM docs WHERE len(w) >= 35)),
repeated AS (SELECT doc_id, k FROM runs JOIN (SELECT s FROM runs GROUP BY s HAVING count(*) > 1) USING (s)),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 35)) AS i FROM repeated),
counted AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, CAST(unnest(range(1, len(w) + 1)) AS BIGINT) AS i FROM docs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS said FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(said, '')) AS kept_sha256
FROM docs LEFT JOIN counted USING (doc_id) LEFT JOIN kept USING (doc_id)"""


COLLOCATIONS = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, w[i:i + k - 1] AS w, k, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 6) AS t(k) WHERE len(w) >= k) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang),
common AS (SELECT * FROM grams WHERE f >= 100),
cuts AS (SELECT lang, w, k, f AS a, unnest(range(1, k)) AS c FROM common WHERE k > 1),
scored AS (SELECT x.lang, x.w, x.a, c, l.f AS l, r.f AS r, n, 1000 * CAST(x.a AS HUGEINT) * n // (CAST(l.f AS HUGEINT) * r.f) AS score FROM cuts AS x JOIN totals AS t ON t.lang = x.lang
  JOIN common AS l ON l.lang = x.lang AND l.w = x.w[1:c] JOIN common AS r ON r.lang = x.lang AND r.w = x.w[c + 1:]),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, c) = 1),
inner_ AS (SELECT lang, w[i:j] AS w, max(f) AS most FROM (SELECT lang, w, f, k, i, unnest(range(i + 1, k + 1)) AS j FROM (SELECT lang, w, f, k, unnest(range(1, k)) AS i FROM common WHERE k > 2)) WHERE j - i + 1 < k GROUP BY ALL),
kept AS (SELECT b.lang, array_to_string(b.w, ' ') AS phrase, a, l, r, n, score FROM best AS b LEFT JOIN inner_ AS i ON i.lang = b.lang AND i.w = b.w WHERE coalesce(most < a, true))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000"""

#: The checksum goes byte by byte through a table that is made first; the rest follows each pane's totals from batch to batch.
PANES = """
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i FROM range(256) AS r(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
given AS (SELECT click_id, epoch_us(coalesce(arrived_at, ts)) AS arrived, epoch_us(ts) AS us, coalesce(kind, 'none') AS kind,
  CASE WHEN abs(value) < 9e16 THEN CAST(floor(100 * value + 0.5) AS BIGINT) ELSE 0 END AS cents FROM clicks WHERE ts IS NOT NULL),
once AS (SELECT * FROM given WHERE click_id IS NULL UNION ALL
  SELECT * FROM (SELECT * FROM given WHERE click_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY arrived, us, kind, cents) = 1)),
dealt AS (SELECT *, CAST(floor(arrived / 86400000000) AS BIGINT) AS d, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(coalesce(CAST(click_id AS VARCHAR), ''), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS sum FROM once, crc),
rows AS (SELECT least(9, (d % 10 + 10) % 10 + greatest(0, sum % 30 - 23)) AS batch, us - (d - (d % 10 + 10) % 10) * 86400000000 AS us, kind, click_id, cents FROM dealt),
timed AS (SELECT *, CAST(floor(us / 3600000000) AS BIGINT) AS hour FROM rows),
marks AS (SELECT b AS batch, max(us) AS w FROM range(10) AS r(b) LEFT JOIN rows ON rows.batch < b GROUP BY b),
wide AS (SELECT t.*, coalesce(m.w >= (hour + 1) * 3600000000 + 172800000000, false) AS late FROM timed AS t JOIN marks AS m USING (batch)),
added AS (SELECT kind, hour, batch, count(*) AS n, sum(cents) AS c FROM wide WHERE NOT late GROUP BY ALL),
summed AS (SELECT *, sum(n) OVER p AS n1, sum(c) OVER p AS c1, min(batch) OVER (PARTITION BY kind, hour) AS first, row_number() OVER p AS k FROM added WINDOW p AS (PARTITION BY kind, hour ORDER BY batch)),
due AS (SELECT kind, hour, first, (SELECT min(m.batch) FROM marks AS m WHERE m.w >= (hour + 1) * 3600000000 + 43200000000) AS ready FROM (SELECT DISTINCT kind, hour, first FROM summed)),
told AS (SELECT kind, hour, CASE WHEN ready IS NULL THEN 9 ELSE greatest(first, ready) END AS at, ready IS NULL AS final FROM due),
panes AS (SELECT t.at AS batch, CASE WHEN final THEN 'final' ELSE 'emit' END AS record, kind, hour, max(n1) AS n_rows, arg_max(c1, s.batch) AS cents FROM told AS t JOIN summed AS s USING (kind, hour) WHERE s.batch <= t.at GROUP BY ALL),
changed AS (SELECT s.*, n1 - n AS n0, c1 - c AS c0 FROM summed AS s JOIN told AS t USING (kind, hour) WHERE s.batch > t.at)
SELECT CAST(batch AS BIGINT) AS batch, 'late' AS record, kind, hour, click_id, CAST(1 AS BIGINT) AS n_rows, cents FROM wide WHERE late
UNION ALL SELECT batch, record, kind, hour, -1, CAST(n_rows AS BIGINT), CAST(cents AS BIGINT) FROM panes
UNION ALL SELECT batch, 'retract', kind, hour, -1, CAST(n0 AS BIGINT), CAST(c0 AS BIGINT) FROM changed
UNION ALL SELECT batch, 'replace', kind, hour, -1, CAST(n1 AS BIGINT), CAST(c1 AS BIGINT) FROM changed"""

WARC = """
WITH own AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, url FROM pages),
digits AS (SELECT *, list_transform([1, 11, 21, 31], lambda i: CAST('0x' || substr(hex, i, 10) AS BIGINT)) AS fives, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST, url NULLS FIRST) AS place,
  first_value(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST, url NULLS FIRST) AS response FROM own)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, array_to_string(list_transform(fives, lambda v: array_to_string(list_transform([35, 30, 25, 20, 15, 10, 5, 0],
  lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> k) % 32 + 1 AS INTEGER), 1)), '')), '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN response END AS refers_to FROM digits"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_templates": URLS, "op3_poisson_mixing": MIXING, "op4_jaccard_components": JACCARD, "op5_chat_masks": CHAT, "op7_repeated_passages": PASSAGES,
        "op9_licence_digests": LICENCES, "op10_decontamination": DECONTAMINATION,
        "op11_collocations": COLLOCATIONS, "op12_pane_revisions": PANES, "op13_warc_archive": WARC,
    }
