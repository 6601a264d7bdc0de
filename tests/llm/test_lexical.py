"""Ranked search against a plain version."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from paperloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def plain(docs, items, k):
    cut = [(i, terms(t)) for i, t in docs]
    cut = [(i, w) for i, w in cut if w]
    n_all, l_all = len(cut), sum(len(w) for _, w in cut)
    tfs = [Counter(w) for _, w in cut]
    df = Counter(t for c in tfs for t in c)
    asked = {}
    for q, t in items:
        asked.setdefault(q, set()).update(terms(t))
    out = []
    for q, ts in asked.items():
        found = []
        for (i, w), c in zip(cut, tfs):
            m = 50 + (50 * len(w) * n_all) // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def data():
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "The", "ñandú", "日本", "x1", "É"] + [f"w{rng.randint(0, 80)}" for _ in range(6)])
    text = lambda n: rng.choice([" ", "-", "\n", "  "]).join(word() for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(400)]
    docs += [(i, "the same text w1 w2") for i in range(1000, 1150)] + [(None, "the w3 w4"), (3, docs[3][1]), (500, None), (501, "... !"), (502, ""), (503, "w5 " * 30000)]
    items = [(i, text(rng.randint(1, 25))) for i in range(25)] + [(30, None), (31, ""), (32, "?!"), (33, "unknown"), (34, "the same w1"), (5, "w9 w9 w10"), (None, "w3 w4"), (34, "the same w1")]
    return docs, items


def check(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("term", F.lit(1)).withColumn("item_id", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("rank", F.lit(1))
    got = lexical.search(d, b, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(docs, items, options["k"])


def test_matches_plain_version(spark):
    check(spark, *data(), k=20)


def test_small_windows_and_blocks(spark):
    check(spark, *data(), k=7, window=16, block_terms=40)


def test_empty(spark):
    docs, items = data()
    check(spark, [], items, k=5)
    check(spark, docs, [], k=5)
    check(spark, [(1, None), (2, "?")], items, k=5)
