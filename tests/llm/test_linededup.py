"""Content-defined line chunks against a plain version."""

import hashlib
import random
import time
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from paperloom.llm import linededup


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def digits(line):
    return int(hashlib.md5(line.encode()).hexdigest()[:2], 16)


def plain_chunks(lines, pairs, singles, divisor, long):
    """(start, end) of the chunks; pairs and singles count neighbouring lines and lines in all texts."""
    out, i = [], 0
    twice = [pairs[p] > 1 for p in zip(lines, lines[1:])] + [False]
    while i < len(lines):
        if not twice[i]:
            if len(lines[i].split()) >= long and singles[lines[i]] > 1:
                out.append((i, i + 1))
            i += 1
            continue
        end = next(j for j in range(i, len(lines)) if not twice[j])  # last line of the run
        hit = lambda k: (31 * digits(lines[k]) + digits(lines[k + 1])) % divisor == 0
        bounds = [i, *[k for k in range(i + 2, end) if hit(k) and not hit(k - 1)], end + 1]
        out += list(zip(bounds, bounds[1:]))
        i = end + 1
    return out


def plain(rows, divisor=4, long=50):
    texts = sorted({(i is None, i or 0, signed(xxhash.xxh64_intdigest(t.encode(), 42)), t) for i, t in rows if t is not None}, key=lambda x: x[:3])
    pairs = Counter(p for k in texts for p in zip(k[3].split("\n"), k[3].split("\n")[1:]))
    singles = Counter(x for k in texts for x in k[3].split("\n"))
    seen, gone = set(), {}
    for key in texts:
        lines = key[3].split("\n")
        gone[key] = []
        for a, b in plain_chunks(lines, pairs, singles, divisor, long):
            c = "\n".join(lines[a:b])
            if c in seen:
                gone[key].append((a, b))
            seen.add(c)
    out = []
    for i, t in rows:
        spans = gone[i is None, i or 0, signed(xxhash.xxh64_intdigest(t.encode(), 42)), t] if t is not None else []
        lost = {k for a, b in spans for k in range(a, b)}
        kept = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in lost) if spans else t
        out.append((i, len(spans), len(lost), kept))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(9)
    passages = ["\n".join(f"line {rng.randint(0, 400)}" for _ in range(rng.randint(2, 15))) for _ in range(20)]
    rows = []
    for i in range(150):
        parts = [rng.choice(passages) if rng.random() < 0.5 else f"own {i} {rng.random()}" for _ in range(rng.randint(0, 8))]
        rows.append((i, "\n".join(parts)))
    rows += [(500, None), (501, ""), (502, "\n\n\n"), (503, "\n\n\n"), (None, passages[0]), (3, rows[3][1]), (504, "same\n" * 2000), (505, passages[1] + "\n" + passages[1])]
    return rows


def test_matches_plain(spark):
    rows = fixture()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, i int, lines string").repartition(5)
    for divisor, long in ((4, 50), (2, 1)):
        got = sorted([(r.doc_id, r.removed_passages, r.removed_lines, r.kept_text) for r in linededup.dedup(docs, divisor=divisor, long=long).collect()], key=str)
        assert got == plain(rows, divisor, long) and sum(g[1] for g in got) > 100


def test_what_is_removed_stands_elsewhere(spark):
    """Each removed chunk stands whole in an earlier text or place, in lines that are kept."""
    rows = [r for r in fixture() if r[1] is not None and r[0] is not None]
    rng = random.Random(2)
    for k in range(40):  # passages that overlap: the third holds halves of the first two, the fourth a part of the third
        p, q, r, s = (f"{w} {k} {rng.random()}" for w in "pqrs")
        rows += [(1000 + 4 * k + j, "\n".join(x)) for j, x in enumerate(([p, q], [r, s], [p, q, r, s], [q, r]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = ["\n" + r.kept_text + "\n" for r in linededup.dedup(docs).collect()]
    cut = linededup.chunks(docs, "doc_id", "text").collect()
    texts = {(i, signed(xxhash.xxh64_intdigest(t.encode(), 42))): t.split("\n") for i, t in rows}
    passages = {"\n".join(texts[r.k_id, r.k_text][r.s : r.e]) for r in cut}
    assert len(passages) > 100 and all(any(f"\n{p}\n" in t for t in kept) for p in passages)
    spans = sorted((r.k_id, r.k_text, r.s, r.e) for r in cut)
    assert all(x[:2] != y[:2] or x[3] <= y[2] for x, y in zip(spans, spans[1:]))  # chunks don't overlap


def test_overlapping_passages(spark):
    """`q r` is not lost with the text in which it first stood."""
    got = linededup.dedup(spark.createDataFrame(list(enumerate(("p\nq", "r\ns", "p\nq\nr\ns", "q\nr"))), "doc_id long, text string")).collect()
    kept = {r.doc_id: r.kept_text for r in got}
    assert kept[0] == "p\nq" and kept[1] == "r\ns" and any("q\nr" in t for t in kept.values())


def test_passages_between_own_lines_are_found(spark):
    """Every repeated passage of two to six lines, and of one long line, goes, wherever it stands between other lines."""
    rng = random.Random(4)
    passages = ["\n".join(f"p{k} {j} {rng.random()}" for j in range(2 + k % 5)) for k in range(60)] + [f"l{k} " * 50 + "end" for k in range(5)]
    rows = [(i, f"own {rng.random()}\n" * rng.randint(0, 3) + p + f"\nown {rng.random()}") for i, p in enumerate(passages * 2)]
    got = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.removed_lines for r in got) == sum(p.count("\n") + 1 for p in passages) and all(p not in r.kept_text for r in got if r.doc_id >= 65 for p in passages)


def test_very_long_texts(spark):
    """Two texts of 160,000 lines that are nearly the same take time linear in their lines."""
    a = [f"line {i}" for i in range(160_000)]
    b = [x if i % 1000 else f"other {i}" for i, x in enumerate(a)]
    docs = spark.createDataFrame([(1, "\n".join(a)), (2, "\n".join(b))], "doc_id long, text string")
    t = time.perf_counter()
    got = {r.doc_id: r for r in linededup.dedup(docs).collect()}
    assert got[1].removed_lines == 0 and got[2].removed_lines == 160_000 - 160 and got[2].kept_text == "\n".join(f"other {i}" for i in range(0, 160_000, 1000))
    assert time.perf_counter() - t < 40


def test_empty(spark):
    assert linededup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
