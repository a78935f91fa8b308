import re

import numpy as np
import pytest
from oracle_check import compare, connect

from rekurve.llm import common, queries, url_rules

RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("m.example.com", "", "allow"), ("example.com", "/de/x", "allow"),
    ("example.com", "/d", "allow"), ("a.b.org", "/", "block"), ("b.org", "/fr/long/path", "allow"), ("b.org", "/é", "block"), ("dup.net", "/", "allow"), ("dup.net", "/", "block"), (None, "/", "block"), ("net", None, "block"),
]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if h and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, "allow")))


def urls():
    rng = np.random.default_rng(3)
    hosts = ["net", "x.net", "example.net", "m.EXAMPLE.net", "example.com", "m.example.com", "a.m.example.com", "org", "a.b.org", "z.a.b.org", "b.org", "xb.org", "dup.net", "net.", ".net", "a..net", "other.io", "", "u@net:80"]
    paths = ["", "/", "/en/1", "/en", "/de/", "/de/x/y", "/d", "/fr/2", "/fr/long/path/3", "/é/4", "/e", "/EN/", "/a/b://c"]
    tails = ["", "?q=/de/", "#/en/", "?a#b"]
    out = [f"http{rng.choice(['', 's'])}://{h}{p}{t}" for h in hosts for p in paths for t in tails]
    return out + [None, "", "no address", "net/", "://", "://net/x", "x://y://net/", "http://net/\n/en/", "http://" + "a." * 500 + "net/" + "p" * 50_000] + [out[40]] * 300


@pytest.mark.parametrize("per_range", [1, 64])
def test_rules(spark, monkeypatch, per_range):
    monkeypatch.setattr(common, "SAMPLE_PER_RANGE", per_range)
    u = urls()
    pages = spark.createDataFrame([(i % 900, x, "h", "v") for i, x in enumerate(u)], "page_id long, url string, host string, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_pages(pages, rules).collect()), key=repr)
    assert got == sorted(((i % 900, *plain(x)) for i, x in enumerate(u)), key=repr)


def test_empty(spark):
    pages, rules = spark.createDataFrame([(1, "http://net/")], "page_id long, url string"), spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert url_rules.judge_pages(pages.limit(0), rules).count() == 0
    assert [tuple(r) for r in url_rules.judge_pages(pages, rules.limit(0)).collect()] == [(1, "net", "/", None, "allow")]


def test_native(spark):
    plan = queries.op2(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    status, _, note = compare(spark, connect(sf), name, queries.QUERIES[name], queries.ORACLES[name], sf)
    assert status == "ok", note
