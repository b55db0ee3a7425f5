"""URL rules against a brute-force version."""

import random
import re

from tidemark.llm.url_filter import judge_urls

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def site(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute(urls, rules, default="allow"):
    out = []
    for page, url in urls:
        host, path = site(url)
        fits = [
            (len(h + (p or "")), len(h), h + (p or ""), v) for h, p, v in rules
            if h and v and (host == h or host.endswith("." + h)) and path.startswith(p or "")
        ]
        best = max(fits, default=None)
        out.append((page, host, path, best and best[2], best[3] if best else default))
    return sorted(out, key=str)


def judged(spark, urls, rules, schema="page_id long, url string"):
    pages = spark.createDataFrame(urls, schema)
    frame = judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    return sorted(map(tuple, frame.select("page_id", "host", "path", "rule", "verdict").collect()), key=str)


def test_cases(spark):
    urls = [
        "http://a.net/x", "http://EXAMPLE.net/en/1?q=/", "https://deep.sub.example.net/en/", "http://example.net/eng",
        "http://example.com/de/1#f", "http://notexample.com/de/1", "http://x.org/fr/", "http://net", "http://net/",
        "http://a.net?x=/en/", "no scheme", "", None, "ftp://u:p@b.example.com:80/de/", "x://", "://a.net/",
        "http://a..net/y", "http://example.net./en/", "http://a.net/://b.org/fr/",
    ]
    rows = list(enumerate(urls)) + [(0, urls[0]), (None, urls[1])]
    assert judged(spark, rows, RULES) == brute(rows, RULES)


def test_random_nested_rules(spark):
    chance = random.Random(5)
    labels, parts = ["a", "b", "com", "x-y", "a.b"], ["/", "/p", "/p/q", "/p/q/r", "", "/-"]

    def host():
        return ".".join(chance.choices(labels, k=chance.randint(1, 4)))

    rules = [(host(), chance.choice(parts), chance.choice(["allow", "block"])) for _ in range(40)]
    rules = list({x[:2]: x for x in rules}.values()) + [("", "/", "block"), ("b", None, "block"), ("a", "/", None)]
    rules = [x for x in rules if x[:2] != ("b", "")]
    urls = [(k, f"http://{host()}{chance.choice(parts)}{chance.choice(parts)}") for k in range(300)]
    assert judged(spark, urls, rules) == brute(urls, rules)


def test_empty_tables_and_clashing_columns(spark):
    assert judged(spark, [(1, "http://a.net/")], []) == [(1, "a.net", "/", None, "allow")]
    assert judged(spark, [], RULES) == []
    pages = spark.createDataFrame([(1, "http://a.net/", "h", "v", 7)], "page_id long, url string, host string, verdict string, stack int")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    row = judge_urls(pages, rules).first()
    assert (row.host, row.verdict, row.stack) == ("a.net", "block", 7)


def test_plan_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    plan = judge_urls(pages, rules)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
