"""URL filters: rules first, then a tree of path templates per host, by DataFrame functions alone."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.llm._store import settle

MAX_RULES = 500  # they become one expression
DEPTH = 6  # segments that always differ in a template; what lies deeper is divided where its labels differ
FAN_OUT = 50  # a node with more children than that has variable segments
PER_CHILD = 4  # a child that has that many times the urls of the mean child, and a FAN_OUT-th of its node's, is none of them
SUPPORT = 5  # labelled urls that a template needs, and a branch to be compared
IMPURE = 0.5  # of a template's labelled urls, smoothed, that are bad
SIMILAR = 3.8416  # z squared: branches below it are of one kind
WILD = "*"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lowered, and path without query and fragment; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (verdict, ``host/path``) that fits, and its verdict; nulls if none does.

    A rule fits its host and all subdomains if the path starts with the rule's. Of equally long rules the first in
    order of characters counts.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        own, _, tail = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + tail)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def shaped(path: Column) -> Column:
    """Segments of a path with their variable characters replaced: long hexadecimal runs, then numbers."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.when(s.rlike("^[0-9a-fA-F]{8,}$"), F.lit("<hex>")).otherwise(F.regexp_replace(s, "[0-9]+", "<n>")))


def _differs(l: str, b: str, all_l: str, all_b: str) -> Column:
    """Whether b bad of l labelled is another share than all_b of all_l, by a z test."""
    l, b, al, ab = (F.col(c).cast("double") for c in (l, b, all_l, all_b))
    gap = b * al - l * ab
    return gap * gap > F.lit(SIMILAR) * l * ab * (al - ab)


def _step(rows: DataFrame, level: int) -> DataFrame:
    """``rows`` with the segment at ``level`` added to the templates of those that have it."""
    here = rows.where(F.size("shape") > level).withColumn("child", F.element_at("shape", level + 1))
    children = here.groupBy("host", "template", "child").agg(F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    strong = F.col("l") >= SUPPORT
    nodes = children.groupBy("host", "template").agg(
        F.count("*").alias("k"), F.sum("n").alias("all_n"), F.sum(F.when(strong, F.col("l")).otherwise(0)).alias("all_l"), F.sum(F.when(strong, F.col("b")).otherwise(0)).alias("all_b"),
        F.sum("l").alias("node_l"), F.sum("b").alias("node_b"),
    )
    alike = strong & ~_differs("l", "b", "all_l", "all_b")
    hot = (F.col("n") * FAN_OUT >= F.col("all_n")) & (F.col("n") * F.col("k") > F.col("all_n") * PER_CHILD)
    variable = (F.col("k") > FAN_OUT) & ~hot & ~(strong & _differs("l", "b", "node_l", "node_b"))
    judged = children.join(nodes, ["host", "template"]).select("host", "template", "child", variable.alias("variable"), alike.alias("alike"))
    several = judged.where("alike").groupBy("host", "template").agg((F.count("*") > 1).alias("several"))
    judged = judged.join(several, ["host", "template"], "left")
    merged = judged.select("host", "template", "child", (F.col("variable") | (F.col("alike") & F.coalesce("several", F.lit(False)))).alias("wild"))
    step = here.join(merged, ["host", "template", "child"]).withColumn("template", F.concat("template", F.lit("/"), F.when(F.col("wild"), F.lit(WILD)).otherwise(F.col("child"))))
    return rows.where(F.size("shape") <= level).unionByName(step.select(*rows.columns))


def templates(urls: DataFrame) -> DataFrame:
    """``urls`` (host, shape, n, labelled, bad), one row each host and shape, with the template of each.

    Level by level, from the host on: where a node has over ``FAN_OUT`` children, the segment is variable and they become
    one wildcard, however many urls each has; only a child with a large share of the node's urls, or with enough labels
    whose share of bad urls differs from the node's, stays itself. Otherwise children with enough labels whose share of
    bad urls doesn't differ from that of all labelled children of the node are one branch, if there are two or more. Only
    sums by node and child are shuffled, after partial sums, so a host with most of the urls is no single task's work.
    """
    rows = settle(urls.withColumn("template", F.lit("")), "shapes")
    deepest = rows.agg(F.max(F.size("shape"))).first()[0] or 0
    for level in range(min(DEPTH, deepest)):
        rows = settle(_step(rows, level), "shapes")
    return rows if deepest <= DEPTH else _deep(rows)


def _deep(rows: DataFrame) -> DataFrame:
    """``rows`` with the templates of shapes of more than ``DEPTH`` segments, whose first ``DEPTH`` have theirs.

    The levels go on, down to the deepest shape, in nodes with labels enough for two branches; elsewhere nothing could be
    told apart. Then from the deepest level up: of the branches of a node with enough labels, those whose share of bad urls
    differs from that of all of them keep their template; all else is part of the node, and at last one wildcard.
    """
    deep = rows.where(F.size("shape") > DEPTH).withColumn("trail", F.array("template"))
    last, columns = DEPTH, deep.columns
    while True:
        going = deep.where((F.size("shape") > last) & (F.size("trail") == last - DEPTH + 1))
        worth = settle(going.groupBy("host", "template").agg(F.sum("labelled").alias("w")).where(F.col("w") >= 2 * SUPPORT), "worth")
        if worth.isEmpty():
            break
        marked = deep.join(worth, ["host", "template"], "left").withColumn("on", F.col("w").isNotNull() & (F.size("shape") > last) & (F.size("trail") == last - DEPTH + 1))
        step = _step(marked.where("on").select(*columns), last).withColumn("trail", F.concat("trail", F.array("template")))
        deep = settle(marked.where(~F.col("on")).select(*columns).unionByName(step.select(*columns)), "deep")
        last += 1
    deep = deep.withColumn("kept", F.lit(None).cast("string"))
    for level in range(last, DEPTH, -1):
        here = deep.withColumn("node", F.get("trail", F.lit(level - DEPTH - 1))).withColumn("unit", F.get("trail", F.lit(level - DEPTH)))
        units = here.where(F.col("kept").isNull() & F.col("unit").isNotNull()).groupBy("host", "node", "unit").agg(
            F.sum("labelled").alias("l"), F.sum("bad").alias("b"), F.max(F.size("shape") > level).alias("more")
        )
        units = units.where(F.col("l") >= SUPPORT)
        apart = units.join(units.groupBy("host", "node").agg(F.sum("l").alias("all_l"), F.sum("b").alias("all_b")), ["host", "node"]).where(_differs("l", "b", "all_l", "all_b"))
        apart = apart.select("host", "unit", F.concat("unit", F.when(F.col("more"), F.lit("/" + WILD * 2)).otherwise("")).alias("own"))
        deep = settle(here.join(apart, ["host", "unit"], "left").withColumn("kept", F.coalesce("kept", "own")).select(*columns, "kept"), "deep")
    whole = F.coalesce("kept", F.concat(F.get("trail", F.lit(0)), F.lit("/" + WILD * 2)))
    return rows.where(F.size("shape") <= DEPTH).unionByName(deep.withColumn("template", whole).select(*rows.columns))


def judge(pages: DataFrame, rules: list[tuple[str, str]], *, labelled: DataFrame | None = None, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Per page: page_id, host, path, rule (or null), verdict (allow or block), template, n_labelled, n_bad.

    The verdict is the rule's. Without one, a page is blocked if its template has ``SUPPORT`` labelled urls or more and
    the smoothed share of bad ones, (bad + 1) / (labelled + 2), is ``IMPURE`` or more. Labelled are the urls that a rule
    judges, bad if blocked, and those of ``labelled`` (url, bad) that no rule judges; a null ``bad`` is false, and a url that
    it holds twice counts twice. A null url, or one without ``://``, has empty host and path and the empty template. Rows
    that repeat count and come out as often; other columns are ignored; an empty table gives an empty one.
    """
    host, path = host_and_path(F.col(url))
    own = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = own.select("*", name.alias("rule"), verdict.alias("ruled"), shaped(F.col("path")).alias("shape"))
    seen = own.select("host", "shape", F.lit(1).alias("n"), F.col("ruled").isNotNull().cast("int").alias("labelled"), F.coalesce(F.col("ruled") == "block", F.lit(False)).cast("int").alias("bad"))
    if labelled is not None:
        h, p = host_and_path(F.col("url"))
        marks = labelled.select(h.alias("host"), p.alias("path"), F.coalesce(F.col("bad").cast("int"), F.lit(0)).alias("bad"))
        marks = marks.where(verdict.isNull()).select("host", shaped(F.col("path")).alias("shape"), F.lit(0).alias("n"), F.lit(1).alias("labelled"), "bad")
        seen = seen.unionByName(marks)
    tree = templates(seen.groupBy("host", "shape").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")]))
    sums = tree.groupBy("host", "template").agg(F.sum("labelled").alias("n_labelled"), F.sum("bad").alias("n_bad"))
    known = settle(tree.select("host", "shape", "template").join(sums, ["host", "template"]), "templates")
    out = own.join(known, ["host", "shape"], "left")
    bad = (F.col("n_labelled") >= SUPPORT) & (F.col("n_bad").cast("double") + 1 >= F.lit(IMPURE) * (F.col("n_labelled").cast("double") + 2))
    verdict = F.coalesce("ruled", F.when(bad, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "n_labelled", "n_bad")
