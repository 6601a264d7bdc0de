"""Language identification: held-out accuracy, the backoff, and odd inputs."""

import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.llm import langid
from tests.conftest import SF


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return langid.fit(docs, ~langid.held_out(F.col("doc_id")))


def test_accuracy_on_held_out(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.predict(docs.withColumn("h", langid.held_out(F.col("doc_id"))), model, ["doc_id", "h", "lang"]).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r.lang == r.lang_pred for r in got if r.h]
    assert len(held) > 30 and sum(held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def one(m, text):
    names, scores = m.predict(pa.array([text], pa.string()), {})
    return names[0], float(scores[0])


def test_backoff():
    m = langid.Model(["a", "b"], [("known", 9, 1)], [("_qu", 0, 8), ("u", 0, 30), ("n", 2, 2)])
    assert one(m, "known")[0] == "a"
    assert one(m, "quz")[0] == "b"  # a trigram
    assert one(m, "u")[0] == "b" and one(m, "ж") == ("a", 0.5)
    many = langid.Model(["a", "b"], [("x", 3, 1)], [])
    assert abs(one(many, "x " * 50_000)[1] - one(many, "x " * 30)[1]) < 1e-9


def test_grams_of_the_model(spark, model):
    """n-grams are those of the padded words, of lengths one to four; words that occur once are kept."""
    docs = spark.createDataFrame([(1, "abc abc", "x"), (2, "ab", "y")], "doc_id long, text string, lang string")
    m = langid.fit(docs, F.lit(True))
    want = {p[i : i + n] for p in ("_abc_", "_ab_") for n in (1, 2, 3, 4) for i in range(len(p) - n + 1)}
    assert set(m.grams) == want and set(m.words) == {"abc", "ab"}
    assert {len(g) for g in model.grams} == {1, 2, 3, 4}


def plain_words(t):
    return re.findall(r"[^\W\d_]+", (t or "").lower())


def plain_fit(rows, smooth=0.5):
    """Log frequencies of words and n-grams by plain loops."""
    langs = sorted({lang for _, lang in rows})
    words, grams = Counter(), Counter()
    for t, lang in rows:
        for w in plain_words(t):
            words[w, lang] += 1
            for n in (1, 2, 3, 4):
                for i in range(len(w) + 3 - n):
                    grams[f"_{w}_"[i : i + n], lang] += 1

    def logs(counts):
        names = {k for k, _ in counts}
        total = {x: sum(counts[k, x] + smooth for k in names) for x in langs}
        return {k: [math.log((counts[k, x] + smooth) / total[x]) for x in langs] for k in names}

    return langs, logs(words), logs(grams)


def plain_predict(langs, words, grams, text):
    total, ws = [0.0] * len(langs), plain_words(text)
    if not ws:
        return "und", 0.0
    for w in ws:
        got = words.get(w)
        for n in () if got else (4, 3, 2, 1):
            known = [grams[g] for i in range(len(w) + 3 - n) if (g := f"_{w}_"[i : i + n]) in grams]
            if known:
                got = [sum(c) / len(known) for c in zip(*known)]
                break
        total = [a + b for a, b in zip(total, got or [0.0] * len(langs))]
    total = [t * min(1.0, 30 / len(ws)) for t in total]
    p = [math.exp(t - max(total)) for t in total]
    return langs[p.index(max(p))], max(p) / sum(p)


def test_matches_plain(spark):
    """Whole operator, training and prediction, against plain loops; ten languages."""
    rng = random.Random(3)
    langs = [f"l{i}" for i in range(10)]
    vocab = {x: ["".join(rng.choices("abcdeéžж", k=rng.randint(1, 7))) for _ in range(40)] for x in langs}
    make = lambda x, k: " ".join(rng.choices(vocab[x], k=k)) + rng.choice(["", "!", " 12_3", "\n"])
    rows = [(i, make(x := rng.choice(langs), rng.randint(1, 40)).title(), x) for i in range(300)]
    tests = [(1000 + i, make(rng.choice(langs), rng.randint(1, 30)) + rng.choice(["", " neu", " zzz"])) for i in range(150)] + [(2000, None), (2001, "1 2"), (2002, "x" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    m = langid.fit(docs, F.lit(True), sample_docs=10**6)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame(tests, "doc_id long, text string"), m, ["doc_id"]).collect()}
    plain = plain_fit([(t, x) for _, t, x in rows])
    for i, t in tests:
        name, score = plain_predict(*plain, t)
        assert abs(got[i][1] - score) < 1e-3 and (got[i][0] == name or score < 0.5 + 1e-3), (t, got[i], name, score)
    kept = langid.accepted(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), m)
    assert kept.count() == len(rows)  # short clean texts among ten languages stay


def test_sample_bound():
    """The drawn share is exact at any size, and the cut-off follows chance."""
    for n in (10, 10**4, 10**10, 10**12):
        expected = n * (langid.drawn_share(3000, n) + 1) / 2**63
        assert abs(expected - min(n, 3000)) < 1
    assert langid.chance_margin(1) == 1.0 and 0.1 < langid.chance_margin(10) < 0.15 and langid.chance_margin(0) == 0.0


def test_odd_inputs(spark, model):
    rows = [(1, None), (2, ""), (3, "123 !? _"), (None, "the of and"), (5, "é"), (5, "é"), (6, "die und der " * 50_000)]
    docs = spark.createDataFrame([(i, t, "x", 0.0) for i, t in rows], "doc_id long, text string, lang_pred string, score double")
    got = langid.predict(docs, model, ["doc_id"]).collect()
    assert len(got) == 7 and [r.lang_pred for r in got if r.doc_id in (1, 2, 3)] == ["und"] * 3
    assert {r.score for r in got if r.doc_id in (1, 2, 3)} == {0.0}
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} <= {None, 5, 6}
    assert langid.predict(docs.limit(0), model, ["doc_id"]).count() == 0
    none = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r.lang_pred for r in langid.predict(docs, none, ["doc_id"]).collect()} == {"und"}
