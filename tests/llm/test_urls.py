from pyspark.sql import functions as F

from pairloom.llm.urls import judge_urls

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"),
         ("org", "block"), ("net/part", "block"), ("com/", "allow"), (None, "block"), ("/x", "block"), ("dup.net/", "allow"), ("dup.net/", "block")]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    best = None
    for rule, action in RULES:
        if rule:
            h, slash, p = rule.partition("/")
            if h and (host == h or host.endswith("." + h)) and path.startswith(slash + p):
                best = max(best or (0, 0, "", ""), (len(rule), len(h), rule, action))
    return host, path, best and best[2], best[3] if best else "allow"


URLS = [
    "http://www.Example.com/en/1", "https://a.example.com/en/x?y", "https://example.com/de/", "http://x.net/es/", "http://x.net",
    "http://x.net/particle", "http://a.org", "http://a.org?x=/", "ftp://dup.net/a#b/", "no scheme", "", None, "http://", "http:///p",
    "http://com/", "http://example.com./en/", "http://notexample.com/en/", "a://b://c.com/d", "http://exämple.com/ü/é", "http://x.net/es",
    "http://" + ".".join(["a"] * 300) + ".com/" + "d/" * 300, "HTTP://WWW.EXAMPLE.COM/en/\n",
]


def frames(spark, urls, rules):
    pages = spark.createDataFrame([(i if i % 5 else None, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, rule string, host string")
    return pages, spark.createDataFrame(rules, "rule string, action string")


def test_against_plain_search(spark):
    got = judge_urls(*frames(spark, URLS + URLS[:3], RULES)).collect()
    want = [(i if i % 5 else None, *plain(u)) for i, u in enumerate(URLS + URLS[:3])]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_empty_tables(spark):
    assert judge_urls(*frames(spark, [], RULES)).count() == 0
    rows = judge_urls(*frames(spark, URLS, [])).collect()
    assert len(rows) == len(URLS) and {(r["rule"], r["verdict"]) for r in rows} == {(None, "allow")}


def test_plan_has_no_python(spark):
    plan = judge_urls(*frames(spark, URLS, RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    assert F is not None
