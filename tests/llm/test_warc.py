"""Revisit resolution against a plain version."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from paperloom.llm import warc

SCHEMA = "record_id long, url string, ts timestamp, kind string, etag string, last_modified string, digest string, headers map<string,string>, at int"


def records():
    rng, out = random.Random(3), []
    urls = ["http://www.a.org/x/", "HTTPS://A.org/x#y", "https://m.a.org:443/x?utm_source=q", "http://b.org/?b=2&a=1", "http://b.org?a=1&b=2&ref=z", "c.org/index.html", None]
    t0 = datetime(2024, 1, 1)
    for i in range(600):
        ts = None if rng.random() < 0.02 else t0 + timedelta(minutes=rng.randint(0, 150))
        pick = lambda *v: rng.choice(v)
        heads = pick(None, {}, {"Date": f"d{i}", "Content-Type": f"c{i}"}, {"etag": f"h{i}", "DATE": f"e{i}", "X": "1"})
        out.append((i // 2 if i % 50 == 0 else i, rng.choice(urls), ts, pick("response", "revisit", "revisit", "request"), pick(None, "e1", "e2"), pick(None, "m1", "m2"), pick(None, "d1"), heads, 1))
    return out


CANON = {"http://www.a.org/x/": "http://a.org/x", "HTTPS://A.org/x#y": "http://a.org/x", "https://m.a.org:443/x?utm_source=q": "http://a.org/x", "http://b.org/?b=2&a=1": "http://b.org?a=1&b=2", "http://b.org?a=1&b=2&ref=z": "http://b.org?a=1&b=2", "c.org/index.html": "http://c.org", None: None}


def plain(rows):
    out = []
    for i, url, ts, kind, etag, mod, dig, heads, _ in rows:
        if kind != "revisit":
            continue
        c = CANON[url]
        full = [r for r in rows if r[3] == "response" and c is not None and CANON[r[1]] == c and ts and r[2] and r[2] < ts]
        if not full:
            out.append((i, c, ts, None, "no_response", None))
            continue
        f = max(full, key=lambda r: (r[2], r[0]))
        ok = True
        for a, b in ((etag, f[4]), (mod, f[5]), (dig, f[6])):
            if a is not None and b is not None:
                ok = a == b
                break
        merged = {k.lower(): v for k, v in (f[7] or {}).items()} | {k.lower(): v for k, v in (heads or {}).items() if k.lower() in warc.UPDATABLE}
        out.append((i, c, ts, f[0], "resolved" if ok else "validator_mismatch", sorted(merged.items()) if ok else None))
    return sorted(out, key=str)


def test_matches_plain(spark):
    rows = records()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for n in (100_000, 40):
        got = [(r.record_id, r.canonical, r.ts, r.refers_to, r.status, sorted(r.headers.items()) if r.headers is not None else None) for r in warc.resolve(df, n).collect()]
        assert sorted(got, key=str) == plain(rows)


def test_canonical(spark):
    df = spark.createDataFrame([(u,) for u in CANON], "u string").select("u", warc.canonical_url(F.col("u")).alias("c"))
    assert {r.u: r.c for r in df.collect()} == CANON


def test_empty(spark):
    assert warc.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_burst(spark):
    """Very many captures of one URL within a second, and one far too early: slices stay near their size, results are right."""
    t0 = datetime(2024, 1, 1)
    rows = [(0, "http://b.org?a=1&b=2&ref=z", datetime(1906, 1, 1), "response", None, None, None, None, 1)]
    rows += [(i, "http://www.a.org/x/", t0 + timedelta(microseconds=i * 700), "response" if i % 9 == 0 else "revisit", f"e{i % 2}", None, None, None, 1) for i in range(1, 900)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [(r.record_id, r.canonical, r.ts, r.refers_to, r.status, sorted(r.headers.items()) if r.headers is not None else None) for r in warc.resolve(df, 50).collect()]
    assert sorted(got, key=str) == plain(rows)
    sizes = [r["count"] for r in warc.sliced(df.withColumn("canonical", F.col("url")), 50).groupBy("slice").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 150 and sum(sizes) == len(rows)


def test_slices_by_size_not_by_range(spark):
    """A capture from 1906 doesn't spoil the slices of 40,000 others within some hours."""
    df = spark.range(40_000).selectExpr("id AS record_id", "'http://a.org' AS canonical", "timestamp_micros(case when id = 7 then -2019686400000000 else 1704067200000000 + id * 990000 end) AS ts")
    sizes = [r["count"] for r in warc.sliced(df, 1000).groupBy("slice").count().collect()]
    assert len(sizes) >= 30 and max(sizes) <= 3000 and sum(sizes) == 40_000
