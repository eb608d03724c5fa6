from __future__ import annotations

import re
from itertools import chain, combinations

import pytest
from pyspark.sql import functions as F

from shiftledger.llm import urlrules

URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/en/1?x", "https://example.net", "https://example.net?q#f", "x://net/", "x://a.net/#",
    "http://notnet/", "http://example.com/de/a", "http://a.Example.com/de", "http://org/fr/1", "http://b.org/fr/", "http://b.org/frx", "://net/a",
    "http://example.net/en/a://b/net", "http://İ.NET/é?x=1&y=2", "http://a.net/\n/b", "http://" + "a." * 3000 + "net/" + "b/" * 3000,
]


def plain(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({i: i + 32 for i in range(65, 91)})
    fits = [r for r in urlrules.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name)) if fits else None


def pages(spark, urls):
    kinds = "page_id long, url string, host int, path int, rule int, tokens int, found int"
    return spark.createDataFrame([(i, u, 1, 1, 1, 1, 1) for i, u in enumerate(urls)] + [(None, "http://a.net/", 1, 1, 1, 1, 1)] * 2, kinds)


def test_given_rules(spark):
    found = {r.page_id: r for r in urlrules.filtered(pages(spark, URLS)).collect() if r.page_id is not None}
    for i, url in enumerate(URLS):
        host, path, rule = plain(url)
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, rule and rule.name), url
        assert found[i].verdict == rule.action if rule else found[i].verdict in ("allow", "block")
    assert urlrules.filtered(pages(spark, URLS)).count() == len(URLS) + 2
    assert urlrules.filtered(pages(spark, URLS).limit(0)).count() == 0
    bare = urlrules.filtered(pages(spark, ["http://other/"]), rules=())
    assert {r.verdict for r in bare.collect()} == {"allow"}


EXAMPLES = [("a b x", "block")] * 6 + [("a c", "allow")] * 5 + [("b c", "allow")] * 4 + [("a b c", "allow"), ("x", "block"), ("d", "block"), ("a b", None)]


def plain_rules(support, confidence):
    known = [(frozenset(t.split()), a) for t, a in EXAMPLES if a]
    tokens = sorted(set(chain.from_iterable(t for t, _ in known)))
    rules = {}
    for size in range(1, len(tokens) + 1):
        for part in combinations(tokens, size):
            held = [a for t, a in known if t >= set(part)]
            for action in ("allow", "block"):
                n = held.count(action)
                if n and n / len(known) >= support and n / len(held) >= confidence:
                    rules[part, action] = n / len(held)
    return {
        k: c for k, c in rules.items()
        if not any(rules.get((tuple(x for x in k[0] if x != out), k[1]), -1) >= c for out in k[0])
    }


@pytest.mark.parametrize(("support", "confidence"), [(0.05, 0.6), (0.2, 0.9)])
def test_mined_rules_like_enumeration(spark, support, confidence):
    frame = spark.createDataFrame([(t.split(), a) for t, a in EXAMPLES], "tokens array<string>, action string")
    found = urlrules.mined(frame, support, confidence).collect()
    assert {(tuple(r.tokens), r.action): pytest.approx(r.confidence) for r in found} == plain_rules(support, confidence)
    sets = spark.createDataFrame([(["a", "b", "x"],), (["q"],), (["b", "c"],)], "tokens array<string>")
    verdicts = dict((tuple(r.tokens), r.action) for r in urlrules.matched(sets, urlrules.mined(frame, support, confidence)).collect())
    assert verdicts == {("a", "b", "x"): "block", ("b", "c"): "allow"}


def test_a_labelled_table_decides_open_urls(spark):
    urls = ["http://a.test/ads/1", "http://b.test/news/2"]
    rows = urlrules.described(pages(spark, urls), urlrules.RULES)
    labelled = rows.select("tokens", F.when(F.array_contains("tokens", "p:ads"), "block").when(F.array_contains("tokens", "p:news"), "allow").alias("action"))
    found = {r.page_id: r.verdict for r in urlrules.filtered(pages(spark, ["https://c.test/ads/9", "https://c.test/news/9"]), labelled=labelled).collect()}
    assert found[0] == "block" and found[1] == "allow"


def test_no_python_in_the_plan(spark):
    plan = urlrules.filtered(pages(spark, URLS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
