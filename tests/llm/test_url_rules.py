from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pytest

from chatweave.llm import url_rules as U
from chatweave.llm.queries import URL_RULES, op6_url_rules
from tests.conftest import SF_CHECK


def plain(url, rules):
    if url is None or "://" not in url:
        return "", "", None, U.DEFAULT
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = []
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), len(h), rule, verdict))
    best = max(fits, default=None)
    return (host, path, best[2], best[3]) if best else (host, path, None, U.DEFAULT)


URLS = [
    None, "", "no scheme", "http://", "http:///x", "HTTP://Blog.Example.ORG/es/1?q#f", "http://example.org", "http://example.org/", "https://example.org/en/1",
    "https://example.org/en/12", "https://myexample.org/es/", "http://a.com/fr/x", "http://com/fr/", "http://x.com/de/#/fr/", "ftp://b.org?x=/es/", "x://y://z.org/es/",
    "http://example.org./es/", "http://a..org/es/", "http://é.org/ü", "http://org/" + "p" * 20_000,
]


@pytest.mark.parametrize("range_rows", [U.RANGE_ROWS, 3])
def test_against_plain_matching(spark, range_rows):
    rng = np.random.default_rng(4)
    hosts, paths = ["a", "b.a", "c.b.a", "a.b", "b"], ["/", "/x", "/x/y", "/x/yz", "/x/y/z", "/w"]
    rules = [(f"{h}{p}", "block" if rng.random() < 0.5 else "allow") for h in hosts for p in paths if rng.random() < 0.6] + URL_RULES
    urls = URLS + [f"http://{rng.choice(['', 'w.', 'v.w.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '1', '/2', '?q'])}" for _ in range(300)]
    rows = list(enumerate(urls)) + [(None, "http://a/x"), (1, ""), (1, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'z' AS host", "'k' AS key", "1 AS part", "'r' AS rule").repartition(4)
    got = U.judge_urls(pages, spark.createDataFrame([*rules, rules[0], (None, "block"), ("x/", None)], "rule string, verdict string"), ["page_id", "url"], range_rows=range_rows).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain(r.url, rules), r.url


def test_hot_url_and_empty(spark):
    pages = spark.createDataFrame([(i, "http://a.org/es/") for i in range(500)], "page_id long, url string")
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    assert {tuple(r) for r in U.judge_urls(pages, rules, ["page_id"], range_rows=20).select("rule", "verdict").collect()} == {("org/", "allow")}
    assert U.judge_urls(pages.limit(0), rules, ["page_id"]).collect() == []
    assert {r.verdict for r in U.judge_urls(pages, rules.limit(0), ["page_id"]).collect()} == {U.DEFAULT}


def test_query(spark):
    pages = pd.read_parquet(f"{SF_CHECK}/pages.parquet")
    got = op6_url_rules(spark, SF_CHECK).toPandas().set_index("page_id")
    assert len(got) == len(pages)
    for i, url in zip(pages.page_id, pages.url):
        r = got.loc[i]
        assert (r.host, r.path, r.rule, r.verdict) == plain(url, URL_RULES)
