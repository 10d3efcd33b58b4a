import re

import pytest

from strandlake.llm import url_filter as uf

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
URLS = [
    None, "", "no scheme", "http://a.net", "http://a.net/", "https://M.Example.NET/en/1?q#f", "https://example.net/de/", "http://x.example.com/de/7", "http://example.com/en/", "http://q.org/fr/",
    "http://notnet/x", "http://a.org?x=/fr/", "ftp://b.org/fr/#y", "http://example.net/en", "x://y://z/", "http://a.net:80/",
]


def expected(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_rules_equal_brute_force(spark):
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(URLS)], "page_id long, url string, html string")
    for r in uf.judge(pages).collect():
        host, path, rule, verdict = expected(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or r["verdict"]) and r["verdict"] in ("allow", "block")


def reference_rank(edges, seeds, rounds=200):
    hosts = {h for e in edges for h in e[:2]} | set(seeds)
    out = {h: sum(w for s, _, w in edges if s == h) for h in hosts}
    rank = dict.fromkeys(hosts, 0.0) | seeds
    for _ in range(rounds):
        flow = dict.fromkeys(hosts, 0.0)
        for s, t, w in edges:
            flow[t] += uf.DAMPING * rank[s] * w / out[s]
        rest = 1 - sum(flow.values())
        rank = {h: flow[h] + rest * seeds.get(h, 0.0) for h in hosts}
    return rank


def test_pagerank_equals_the_reference(spark):
    edges = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "d", 3.0)]
    seeds = {"a": 0.5, "b": 0.5}
    made = uf.propagate(spark.createDataFrame(edges, "source string, target string, weight double"), spark.createDataFrame(list(seeds.items()), "host string, mass double"), rounds=60, tolerance=1e-9)
    want = reference_rank(edges, seeds)
    for r in made.collect():
        assert r["rank"] == pytest.approx(want[r["host"]], abs=1e-6)


def test_links_spread_trust_and_distrust(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    pages = [(1, "http://good.org/fr/", link("friend.info")), (2, "http://friend.info/", None), (3, "http://farm.info/", link("spam.net")), (4, "http://spam.net/", link("farm.info")), (5, "http://alone.info/", '<A HREF=/x>')]
    made = {r["host"]: r["verdict"] for r in uf.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert made == {"good.org": "allow", "friend.info": "allow", "farm.info": "block", "spam.net": "block", "alone.info": "allow"}


def test_empty(spark):
    assert uf.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
