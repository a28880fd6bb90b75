"""Resolution of revisits against a search through all earlier records."""

import random
from datetime import datetime, timedelta

import pytest
from hedonica.llm import warc as W
from pyspark.sql import functions as F

SCHEMA = f"record_id string, url string, date timestamp, type string, status int, headers {W.HEADERS}, body string"
T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("url, want", [
    ("HTTPS://www.Example.COM:443/a/b/?b=2&utm_source=x&a=1#top", "example.com/a/b?a=1&b=2"),
    ("http://u:p@m.example.com/A/?ref=1", "m.example.com/A"), ("example.com", "example.com"),
    ("http://example.com:8080//", "example.com:8080"), ("", None), (None, None), ("  ", None), ("#x", None),
    ("http://e.com?reference=1", "e.com?reference=1"),
])
def test_canonical(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(W.canonical(F.col("u"))).first()[0] == want


def test_parsed(spark):
    text = (
        "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:1>\r\nWARC-Target-URI: http://a.b/c:d\r\n"
        "WARC-Date: 2024-01-01T00:00:00Z\r\n\r\nHTTP/1.1 200 OK\r\nETag: \"x:y\"\r\nVary: a\r\nvary: b\r\nbroken\r\n\r\nbody\r\n\r\nmore"
    )
    df = W.parsed(spark.createDataFrame([(text, 1), (None, 2), ("", 3), ("WARC/1.1\r\n\r\nHTTP/1.1 x", 4)], "record string, type int"))
    rows = df.collect()
    r = rows[0]
    assert (r.record_id, r.url, r.date, r.type, r.status, r.body) == ("<urn:1>", "http://a.b/c:d", T0, "response", 200, "body\r\n\r\nmore")
    assert [tuple(h) for h in r.headers] == [("etag", '"x:y"'), ("vary", "a"), ("vary", "b")]
    assert all(x.record_id is None and x.headers == [] for x in rows[1:])


def brute(rows):
    out = []
    for rid, url, date, kind, status, headers, _ in rows:
        full = kind == "response" and status == 200
        revisit = kind == "revisit" and status == 304
        earlier = [r for r in rows if revisit and r[3] == "response" and r[4] == 200 and r[1] == url and url and date and r[2] and r[2] < date]
        best = max(earlier, key=lambda r: (r[2], r[0]), default=None)
        mine = dict(headers)
        outcome, final = "full" if full else "other", headers
        if revisit:
            outcome = "no_earlier"
            if best:
                theirs = dict(best[5])
                strip = lambda t: t.removeprefix("W/")
                if "etag" in mine and "etag" in theirs:
                    agree = strip(mine["etag"]) == strip(theirs["etag"])
                elif "last-modified" in mine and "last-modified" in theirs:
                    agree = mine["last-modified"] == theirs["last-modified"]
                else:
                    agree = None
                outcome = {True: "resolved", False: "changed", None: "unverified"}[agree]
                if agree:
                    new = [h for h in headers if h[0] in W.PERMITTED]
                    final = [h for h in best[5] if h[0] not in dict(new)] + new
        out.append((rid, outcome, best[0] if best else None, [tuple(h) for h in final]))
    return sorted(out, key=str)


def made(n, hot):
    rng, rows = random.Random(n), []
    for i in range(n):
        url = "hot.com/x" if rng.random() < hot else rng.choice([f"s{j}.com/a" for j in range(9)] + [None])
        date = None if rng.random() < 0.03 else T0 + timedelta(minutes=rng.randrange(n // 2))
        kind, status = rng.choice([("response", 200), ("response", 200), ("revisit", 304), ("revisit", 304), ("response", 500), ("request", None), (None, 200)])
        headers = []
        if rng.random() < 0.8:
            headers.append(("etag", rng.choice(["W/", ""]) + rng.choice(['"a"', '"b"'])))
        if rng.random() < 0.4:
            headers.append(("last-modified", rng.choice("xy")))
        headers += [("content-length", str(i)), ("vary", rng.choice("pq"))]
        rows.append((f"r{i:04d}", url, date, kind, status, headers, f"body {i}"))
    return rows


@pytest.mark.parametrize("hot, parts", [(0.0, 1), (0.4, 7), (0.95, 16)])
def test_resolved(spark, hot, parts):
    rows = made(400, hot)
    records = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("key", "part", "near", "found")})
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = W.resolved(records).collect()
        bodies = W.with_body(W.resolved(records), records).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    got = sorted(((r.record_id, r.outcome, r.refers_to, [tuple(h) for h in r.headers]) for r in got), key=str)
    want = brute(rows)
    assert got == want
    stand_for = {w[0]: w[2] for w in want if w[1] == "resolved"}
    assert {b.record_id: b.body for b in bodies} == {k: f"body {int(v[1:])}" for k, v in stand_for.items()}


def test_empty(spark):
    assert W.resolved(spark.createDataFrame([], SCHEMA)).collect() == []


def test_crawl(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", "<p>one</p>"), (2, "https://a.com", "two"), (3, None, None)], "page_id long, url string, html string")
    got = {r.record_id: r for r in W.resolved(W.parsed(W.crawl(pages, 10))).collect()}
    assert len(got) == 6
    assert got["urn:revisit:2"].outcome == "resolved" and got["urn:revisit:2"].refers_to == "urn:response:2"
    assert got["urn:revisit:1"].outcome == "changed" and got["urn:revisit:3"].outcome == "no_earlier"
    assert ("cache-control", "max-age=120") in [tuple(h) for h in got["urn:revisit:2"].headers]
    assert ("content-length", "3") in [tuple(h) for h in got["urn:revisit:2"].headers]


def test_versions_need_the_time_of_a_revisit(spark, small_dir):
    pages = spark.read.parquet(f"{small_dir}/pages.parquet")
    got = {r.record_id: r for r in W.resolved(W.parsed(W.crawl_of_versions(pages, 5_000))).collect()}
    assert {r.outcome for r in got.values()} == {"full", "other", "resolved", "no_earlier", "changed", "unverified"}
    # visit 1 lies between two responses of its URL: the later one must not be taken
    assert got["urn:response:8:2"].outcome == "full" and got["urn:revisit:8:1"].outcome == "resolved"
    assert got["urn:revisit:8:1"].refers_to == "urn:response:8:0"
    assert got["urn:revisit:8:3"].refers_to == "urn:response:8:2" and got["urn:revisit:8:3"].outcome == "resolved"
    assert got["urn:revisit:4:3"].outcome == "changed" and got["urn:revisit:3:-1"].refers_to is None
    assert got["urn:revisit:2:1"].outcome == "unverified" and got["urn:response:5:2"].outcome == "other"
    assert "last-modified" in [h.name for h in got["urn:revisit:1:1"].headers]


def test_versions_of_nothing(spark):
    schema = "page_id long, url string, html string, record string"
    assert W.crawl_of_versions(spark.createDataFrame([], schema), 5).collect() == []
    rows = spark.createDataFrame([(0, None, None, "x"), (None, "http://a.com", "a", None), (4, "http://a.com", "", "x")], schema)
    got = W.resolved(W.parsed(W.crawl_of_versions(rows, 5))).collect()
    assert len(got) == 4 + 2 + 4
    assert all(r.outcome in ("full", "no_earlier") for r in got if r.canonical_url is None)
