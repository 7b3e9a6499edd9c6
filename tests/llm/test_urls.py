from __future__ import annotations

from gradus.llm import urls
from gradus.llm.queries import RULES

ODD = [None, "", "no scheme/path", "http://", "http://com", "http://com/", "http://COM/a?b/c", "https://www.Example.com/en/x", "https://a.example.com/en", "https://a.example.com/en/1#f", "http://xcom/", "http://b.net/es/1", "ftp://h.org?x://y/"]


def judged(spark, rows, **more):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(rows)], "page_id long, url string, host string, template int")
    return {r.page_id: r for r in urls.judge(pages, RULES, **more).collect()}


def test_odd_urls(spark):
    got = [tuple(judged(spark, ODD)[i])[1:5] for i in range(len(ODD))]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("com", "", None, "allow"), ("com", "/", "com/", "allow"), ("com", "/a", "com/", "allow"),
        ("www.example.com", "/en/x", "www.example.com/en/", "allow"), ("a.example.com", "/en", "com/", "allow"), ("a.example.com", "/en/1", "example.com/en/", "block"), ("xcom", "/", None, "allow"),
        ("b.net", "/es/1", "net/es/", "block"), ("h.org", "", None, "allow"),
    ]
    assert judged(spark, []) == {} and len(judged(spark, ODD + ODD)) == 2 * len(ODD)


def test_templates_learn_from_labels(spark):
    pages = [f"http://a.org/spam/{i}" for i in range(20)] + [f"http://a.org/good/{i}" for i in range(20)] + [f"http://a.org/{w}" for w in ("deadbeef99", "cafebabe01")]
    labels = spark.createDataFrame([(f"http://a.org/spam/{1000 + i}", True) for i in range(9)] + [(f"http://a.org/good/{1000 + i}", False) for i in range(9)], "url string, bad boolean")
    got = judged(spark, pages, labelled=labels)
    assert all(got[i].verdict == "block" and got[i].template == "/spam/<n>" and got[i].n_bad == 9 for i in range(20))
    assert all(got[i].verdict == "allow" for i in range(20, 42)) and got[41].template == "/<hex>"


def test_similar_branches_merge(spark):
    labels = spark.createDataFrame([(f"http://a.org/{b}/{i}", i % 2 == 0) for b in ("x", "y") for i in range(10)] + [(f"http://a.org/z/{i}", True) for i in range(10)], "url string, bad boolean")
    got = judged(spark, ["http://a.org/x/1", "http://a.org/y/1", "http://a.org/new/1"], labelled=labels)
    assert got[0].template == got[1].template == "/*/<n>" and got[2].template == "/new/<n>" and got[2].verdict == "allow"


def test_variable_segments(spark):
    got = judged(spark, [f"http://a.org/u/{chr(97 + i // 26)}{chr(97 + i % 26)}q" for i in range(80)] + ["http://a.org/a/b/c/d/e/f/g/h"])
    assert got[0].template == "/u/*" and got[80].template == "/a/b/c/d/e/f/**"


def test_hot_child_and_repeats_leave_the_wildcard(spark):
    slugs = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}q" for i in range(80)]
    labels = spark.createDataFrame([(f"http://a.org/u/{s}", True) for s in slugs[:10]], "url string, bad boolean")
    got = judged(spark, [f"http://a.org/u/{s}" for s in slugs] + [f"http://a.org/u/hot/{i}" for i in range(400)], labelled=labels)
    assert all((got[i].template, got[i].verdict, got[i].n_bad) == ("/u/*", "block", 10) for i in range(80))
    assert got[80].template == "/u/hot/<n>" and got[80].verdict == "allow"
    got = judged(spark, [f"http://a.org/u/{s}" for s in slugs for _ in range(6)], labelled=labels)
    assert {(r.template, r.verdict) for r in got.values()} == {("/u/*", "block")}


def test_labelled_child_stays_beside_a_wildcard(spark):
    slugs = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}q" for i in range(80)]
    labels = spark.createDataFrame([(f"http://a.org/u/{s}", False) for s in slugs] + [("http://a.org/u/spam", True)] * 8, "url string, bad boolean")
    got = judged(spark, [f"http://a.org/u/{s}" for s in [*slugs, "spam"]], labelled=labels)
    assert (got[80].template, got[80].verdict) == ("/u/spam", "block") and got[0].template == "/u/*" and got[0].verdict == "allow"


def test_deep_branches_differ(spark):
    top = "http://a.org/a/b/c/d/e/f"
    names = [f"{chr(97 + i)}q" for i in range(12)]
    labels = [(f"{top}/g/bad/{x}/y", True) for x in names] + [(f"{top}/g/good/{x}/y", False) for x in names] + [("http://a.org/q/b/c/d/e/f/g/h/k", True)] * 8 + [("http://a.org/q/b/c/d/e/f/g/h/m", True)] * 8
    pages = [f"{top}/g/bad/{names[0]}/y", f"{top}/g/good/{names[0]}/y", f"{top}/z/1", "http://a.org/q/b/c/d/e/f/g/h/k", "http://a.org/q/b/c/d/e/f/g/h/m"]
    got = judged(spark, pages, labelled=spark.createDataFrame(labels, "url string, bad boolean"))
    assert [(got[i].template, got[i].verdict) for i in range(5)] == [
        ("/a/b/c/d/e/f/g/bad/**", "block"), ("/a/b/c/d/e/f/g/good/**", "allow"), ("/a/b/c/d/e/f/**", "allow"), ("/q/b/c/d/e/f/**", "block"), ("/q/b/c/d/e/f/**", "block"),
    ]


def test_templates_judge_pages_without_a_rule(spark):
    """At sf0.1 780 of the 1,395 pages without a rule are in templates with labels enough, and 30 of them go by these."""
    from gradus.llm.queries import op1_url_templates

    rows = op1_url_templates(spark, "/root/testdata/sf0.1").where("rule IS NULL").collect()
    judged = [r for r in rows if (r.n_labelled or 0) >= urls.SUPPORT]
    gone = [r for r in rows if r.verdict == "block"]
    assert (len(rows), len(judged), len(gone)) == (1395, 780, 30)
    assert all(r in judged and (r.n_bad + 1) / (r.n_labelled + 2) >= urls.IMPURE for r in gone) and any("*" in r.template for r in gone)


def test_rules_are_labels_too(spark):
    labels = spark.createDataFrame([("http://a.net/es/1", False)] * 9 + [("http://a.net/en/1", None)] * 5 + [("http://a.net/de/1", True)] * 5 + [(None, True)] * 5, "url string, bad boolean")
    got = judged(spark, [f"http://a.net/es/{i}" for i in range(6)] + ["http://a.net/en/2", "http://a.net/de/3", "http://a.net/pt/3", None], labelled=labels)
    assert [(got[i].rule, got[i].verdict, got[i].n_labelled, got[i].n_bad) for i in (0, 6, 7, 8)] == [("net/es/", "block", 11, 11), (None, "allow", 5, 0), (None, "block", 11, 11), (None, "allow", 0, 0)]
    assert got[9].verdict == "block" and got[9].host == ""  # five bad labels without an address are the empty template's
