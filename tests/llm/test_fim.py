"""Fill-in-middle against a plain version, and the boundary lists against lists."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(i, t):
    t = t or ""
    w, d = TOKEN.findall(t), hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()
    h = [int(d[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if t == "" or "<P>" in t or "<S>" in t or "<M>" in t or h[2] % 100 >= 50:
        return len(w), "plain", None, None, t
    if h[3] % 100 < 80:
        return len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows():
    rng = random.Random(3)
    piece = lambda: rng.choice(["a", "ñu", "日本", "😀x", "<", "<P", "S>", "word"]) + rng.choice([" ", "  ", "\n", "\t\x0b", " ", "\x1c", ""])
    texts = ["".join(piece() for _ in range(rng.randint(0, 60))) for _ in range(40)]
    out = [(i, rng.choice(texts)) for i in range(200)]
    out += [(i, texts[0]) for i in range(300, 500)]  # one group of a third of the rows
    return out + [(600, None), (601, ""), (602, " "), (603, "\n\n"), (604, "x"), (605, "has <M> mark"), (606, " lead"), (607, "trail  "), (None, "no id here at all"), (3, out[3][1]), (608, "long words  " * 30000), (609, "long words  " * 30000)]


def check(spark, data, **options):
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("coded", F.lit(1)).withColumn("h", F.lit("clash")).withColumn("id", F.lit(0))
    got = fim.transform(docs, **options)
    got = got.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    want = sorted(((i, *plain(i, t), t or "") for i, t in data), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_matches_plain_version(spark):
    check(spark, rows())


def test_full_sieve_changes_nothing(spark):
    check(spark, rows(), bits=1)


def test_empty(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_boundary_lists():
    rng = random.Random(5)
    for n, most in ((0, 0), (1, 1), (1, 1000), (50, 60), (200, 100_000), (3000, 3000)):
        ends = np.array(sorted(rng.sample(range(1, most + 1), n)), np.int64)
        coded = fim.encode(ends, most)
        assert fim.length(coded) == n and [fim.select(coded, k) for k in range(n)] == ends.tolist()
    text = "ab  cd\n" * 50
    whole = fim.boundaries(text)
    assert all((fim.boundaries(text, size) == whole).all() for size in (1, 2, 3, 7, 100)) and len(whole) == 101
