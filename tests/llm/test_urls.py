"""URL filters: long URLs, long lists, false positives."""

from __future__ import annotations

import time

from obsmill.llm import common, url_filter

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def pages(spark, urls):
    return spark.createDataFrame([(k, u, "h", "v", "r") for k, u in enumerate(urls)], "page_id long, url string, host string, verdict string, row string")


def test_very_long_urls(spark):
    host = "a." * 30_000
    urls = [f"http://{host}net/x", f"http://{host}example.net/en/{'p/' * 30_000}", f"http://{host}org/en/", "http://example.com/de/" + "x" * 200_000, "http://" + "x" * 100_000 + ".org/fr/", "y" * 100_000]
    began = time.time()
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages(spark, urls), RULES).collect()}
    assert got == {0: ("net/", "block"), 1: ("example.net/en/", "allow"), 2: (None, "allow"), 3: ("example.com/de/", "block"), 4: ("org/fr/", "allow"), 5: (None, "allow")}
    assert time.time() - began < 60


def test_lists_too_long_to_broadcast(spark, monkeypatch):
    sites = spark.createDataFrame([(f"s{k}.example.com", "/" if k % 2 else f"/p{k % 7}/") for k in range(3000)], "host string, path string")
    urls = [f"http://a.s{k}.example.com/p{k % 7}/x" for k in range(0, 6000, 7)] + ["http://s1.example.com/"] * 400
    want = sorted(map(tuple, url_filter.judge(pages(spark, urls), RULES, sites).collect()), key=str)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 100)
    assert sorted(map(tuple, url_filter.judge(pages(spark, urls), RULES, sites).collect()), key=str) == want
    assert all((v == "block") == (int(h.split("s")[1].split(".")[0]) < 3000) for _, h, _, _, v, _ in want)


def test_filter_grows_with_the_list(spark):
    sites = [(f"s{k}.example.com", "/") for k in range(20_000)]
    entries = spark.createDataFrame(sites, "host string, path string")
    bits = url_filter.bloom(entries, url_filter.blocks_for(len(sites)))
    test = " AND ".join(f"(element_at({bits}, 4 * {url_filter._block(url_filter.blocks_for(len(sites)))} + {w + 1}) & {url_filter._mask(w)}) = {url_filter._mask(w)}" for w in range(4))
    rate = lambda text: spark.range(20_000).selectExpr(f"{text} AS k").where(test).count() / 20_000
    assert rate("concat('s', id, '.example.com\n/')") == 1.0
    assert rate("concat('t', id, '.example.com\n/')") < 0.02
    assert url_filter.blocks_for(10**9) == url_filter.MAX_BLOCKS


def test_no_entries(spark):
    got = url_filter.judge(pages(spark, ["http://a.net/", None]), (), ()).collect()
    assert {(r["host"], r["rule"], r["verdict"]) for r in got} == {("a.net", None, "allow"), ("", None, "allow")}
