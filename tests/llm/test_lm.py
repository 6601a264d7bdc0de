"""Language-model scores against plain loops over exact counts, and properties of the filter."""

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import lm


def words(t):
    for b in "\t\n\x0b\x0c\r":
        t = (t or "").replace(b, " ")
    return [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).split(" ") if w]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def plain(docs):
    """n_tokens, n_known, train_tokens, base_score, score by id and text; counts of the score are rounded to their level's middle."""
    train = [words(t) for i, t in docs if not held(i)]
    c = Counter(w for t in train for w in [*t, "<end>"])
    pairs = Counter(p for t in train for p in zip(["<begin>", *t], [*t, "<end>"]))
    n, v, mu = sum(c.values()), len(c), len(pairs) / len(c)
    middle = lambda x: (2 ** (x.bit_length() - 1) + 2 ** x.bit_length() - 1) / 2 if x else 0
    begin = middle(len(train))
    out = {}
    for i, t in docs:
        w = words(t)
        score = 0.0
        for h, x in zip(["<begin>", *w], [*w, "<end>"]):
            before = begin if h == "<begin>" else middle(c[h])
            score += math.log10((min(middle(pairs[h, x]), before) + mu * (middle(c[x]) + 1) / (n + v + 1)) / (before + mu))
        tokens = [*w, "<end>"]
        out[i, t] = (len(tokens), sum(c[x] > 0 for x in tokens), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens), score)
    return out


def data():
    rng = random.Random(9)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 3000}"
    chain = {}
    def text(n):
        out = [word()]
        for _ in range(n):  # words often have the same follower
            out.append(chain.setdefault(out[-1], word()) if rng.random() < 0.6 else word())
        return rng.choice([" ", "\n", " \t "]).join(out).title()
    docs = [(i, text(rng.randint(0, 80))) for i in range(500)]
    docs += [(i, "one Common text ñ") for i in range(1000, 1200)]
    return docs + [(None, "no id"), (3, docs[3][1]), (600, None), (601, ""), (602, " \n"), (603, "Very long " * 50000), (604, "É É é")]


@pytest.mark.parametrize(("joined", "bits"), [(False, lm.BITS), (False, 200), (True, 200)])
def test_matches_plain_version(spark, joined, bits):
    docs = data()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("word", F.lit(1)).withColumn("row", F.lit("clash")).withColumn("c0", F.lit(0))
    model = lm.fit(df, ~lm.held_out(F.col("doc_id")), per_entry=bits)
    got = lm.score(df, model, ["doc_id", "text", "row"], broadcast_bytes=0 if joined else lm.BROADCAST_BYTES, head_words=100 if joined else 1 << 18).collect()
    want = plain(docs)
    assert len(got) == len(docs)
    off = []
    for r in got:
        n, known, total, base, score = want[r.doc_id, r.text]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.row) == (n, known, total, "clash") and abs(r.base_score - base) < 1e-6 * max(1, -base)
        off.append(abs(r.score - score) > 1e-6 * max(1, -score))
    # a false positive raises a count by a level: one in about 80 probes with the usual bits, hardly any with many
    assert sum(off) <= 2 if bits > lm.BITS else off
    fresh = [r for r in got if held(r.doc_id)]
    assert sum(r.score for r in fresh) > sum(r.base_score for r in fresh)  # better than the base on unseen texts
    assert all(r.score < 0 for r in got)


def test_filter():
    rng = np.random.default_rng(1)
    x, counts = rng.integers(0, 1 << 63, 50_000, np.int64).view(np.uint64), (rng.pareto(0.8, 50_000) + 1).astype(np.int64)
    x, counts = lm.summed(x, counts)
    parts = [lm.build(x[lm.segment_of(x, 4) == s], counts[lm.segment_of(x, 4) == s]) for s in range(4)]
    f = lm.Filter(b"".join(parts), np.array([len(p) // 8 for p in parts]))
    found = f.levels(x)
    assert (found >= lm.level(counts)).all() and (found > lm.level(counts)).mean() < 0.02
    assert (f.levels(rng.integers(0, 1 << 63, 50_000, np.int64).view(np.uint64)) > 0).mean() < 0.02
    assert lm.level(np.array([1, 2, 3, 4, 7, 8])).tolist() == [1, 2, 2, 3, 3, 4] and lm.count_of(np.array([0, 1, 2, 3])).tolist() == [0, 1, 2.5, 5.5]


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = lm.score(df, lm.fit(df, F.lit(False)), ["doc_id"]).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows) == [(1, 3, 0, 0, 0, 0), (2, 1, 0, 0, 0, 0)]
    none = df.limit(0)
    assert lm.score(none, lm.fit(none, F.lit(True)), ["doc_id"]).count() == 0


def test_large_filter_moves_packed_requests(spark, monkeypatch):
    """Where the filter isn't broadcast, each token costs a few bytes of disk, and many desks, copies and units give the scores of the broadcast filter."""
    for name, value in (("SEGMENT_TOKENS", 1000), ("TOGETHER", 2), ("ASKED", 3000)):
        monkeypatch.setattr(lm, name, value)
    df = spark.createDataFrame(data(), "doc_id long, text string").repartition(3).cache()
    model = lm.fit(df, ~lm.held_out(F.col("doc_id")))
    assert model.pair_segments > 20
    want = lm.score(df, model, ["doc_id", "text"]).collect()
    sizes, stage = {}, lm.stage

    def sized(made, label):
        out = stage(made, label)
        sizes[label] = sizes.get(label, 0) + sum(os.path.getsize(f.removeprefix("file://")) for f in out.inputFiles())
        return out

    monkeypatch.setattr(lm, "stage", sized)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 60)
    try:
        got = lm.score(df, model, ["doc_id"], broadcast_bytes=0).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    near = lambda rows: sorted((r.doc_id or -1, r.n_tokens, round(r.score, 6)) for r in rows)
    assert near(got) == near(want)
    # one hash of eight bytes for each token, history and pair would be 24
    assert sum(sizes.values()) < 12 * sum(r.n_tokens for r in got)
