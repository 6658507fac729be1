import random

import pytest

from codelattice.llm import components, url_filter as op


@pytest.mark.parametrize("url,host,path,rule", [
    ("HTTP://WWW.Example.NET/en/1?x", "www.example.net", "/en/1", "example.net/en/"),
    ("https://example.net/de/", "example.net", "/de/", "net/"), ("https://a.example.com/de/2#t", "a.example.com", "/de/2", "example.com/de/"),
    ("https://notexample.com/de/2", "notexample.com", "/de/2", None), ("x://org/fr/a://b", "org", "/fr/a://b", "org/fr/"), ("https://internet/", "internet", "/", None),
    ("https://example.net", "example.net", "", None), ("ftp://a.net?q", "a.net", "", None), (None, "", "", None), ("no scheme", "", "", None), ("://net/x", "net", "/x", "net/"),
])
def test_parts_and_rules(spark, url, host, path, rule):
    r = op.judge(spark.createDataFrame([(1, url, None)], "page_id bigint, url string, html string")).first()
    assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
    assert r["verdict"] == ("block" if rule in ("net/", "example.com/de/") else "allow")


def test_decisions_spread_to_aliases(spark):
    link = lambda u: f"<html><link href='{u}' rel=canonical></html>"
    rows = [
        (1, "https://a.com/x", link("https://bad.net/1")), (2, "https://bad.net/1", ""), (3, "https://b.com/y#f", '<meta http-equiv="refresh" content="0; URL=https://a.com/x">'),
        (4, "https://c.com/z", link("https://d.com/z")), (5, "https://e.com/", link("https://bad.net/2")), (6, "https://x.example.net/en/9", link("https://e.com/")),
        (7, "https://f.com/p/q", '<link rel="canonical" href="/moved">'), (8, "https://f.com/moved", link("https://bad.net/3")), (9, "https://g.com/", "<a href='https://bad.net/1'>"), (10, "https://a.com/x", None),
    ]
    got = {r["page_id"]: r["verdict"] for r in op.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    # 5 hangs on a blocked URL and on the explicitly allowed 6: allow has precedence.
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "block", 9: "allow", 10: "block"}


def test_given_edges_and_empty(spark):
    pages = spark.createDataFrame([(1, "https://a.com/", None, "https://b.net/")], "page_id bigint, url string, html string, redirect string")
    assert op.judge(pages).first()["verdict"] == "block"
    edges = spark.createDataFrame([("https://a.com/", "https://b.net/"), (None, "x")], "url string, alias string")
    assert op.judge(pages.drop("redirect"), edges=edges).first()["verdict"] == "block"
    assert op.judge(pages.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)] + [(5, 5)]
    label = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in range(300):
        for a, b in pairs:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame([*pairs, (None, 3)], "a bigint, b bigint")).collect()}
    assert got == label
