"""Mixing: targets against plain water filling, and the properties of dependent rounding."""

import random

from pyspark.sql import functions as F

from paperloom.llm import mixing


def plain_targets(sizes, share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    w = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    left, out, free = share * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(w[n] for n in free)
        full = {n for n in free if level * w[n] >= cap * sizes[n]}
        if not full:
            out |= {n: level * w[n] for n in free}
            break
        out |= {n: cap * sizes[n] for n in full}
        left -= sum(out[n] for n in full)
        free -= full
    return out


def rows(n=3000):
    rng = random.Random(2)
    names = ["src0"] * 6 + ["b", "Z", None, "é"]
    out = [(i, " ".join(["w"] * min(4000, int(rng.paretovariate(0.9)))), rng.choice(names)) for i in range(n)]
    out += [(5000, None, "b"), (5001, "", "empty"), (5002, "  \n", "b"), (None, "a b c", "b"), (None, "a b c d", "b")]
    return out + [(6000, "one two three", "src0")] * 41 + [(6001, "x y", "Z")] * 2


def run(spark, data, parts, **more):
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("total", F.lit(1)).repartition(parts)
    allocation, targets = mixing.mix(docs, **more)
    got = mixing.taken_rows(allocation, targets).select("id", "size", "source_size", "target", "copies", "taken").collect()
    return docs, sorted(map(tuple, got), key=str), targets


def test_mix(spark):
    data = rows()
    docs, got, targets = run(spark, data, 7)
    assert got == run(spark, list(reversed(data)), 3)[1]
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes)
    assert {r.source: round(r.target, 6) for r in targets.collect()} == {s: round(t, 6) for s, t in want.items()}
    assert len(got) == len(data) and sorted(x[1] for x in got) == sorted(len((t or "").split()) for _, t, _ in data)
    by_target = {}
    for _, size, source_size, target, copies, taken in got:
        rate = target / source_size if source_size else 0
        assert taken == size * copies and int(rate) <= copies <= min(2, int(rate) + 1)
        by_target.setdefault((source_size, target), []).append((size, taken))
    for (_, target), v in by_target.items():
        assert abs(sum(t for _, t in v) - target) <= max(s for s, _ in v)
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(x[4] for x in got)


def test_expectation(spark):
    """Each document is taken as often as its rate says, over seeds."""
    data = [(i, " ".join(["w"] * (1 + i * i % 17)), "ab"[i % 2]) for i in range(40)]
    total = {}
    for seed in range(8):
        for i, _, source_size, target, copies, _ in run(spark, data, 2, seed=seed * 1000)[1]:
            total.setdefault(target / source_size, []).append(copies)
    for rate, copies in total.items():
        assert abs(sum(copies) / len(copies) - rate) < 0.12


def test_empty_and_zero(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    allocation, targets = mixing.mix(docs)
    assert mixing.taken_rows(allocation, targets).count() == 0 and mixing.apply_mix(docs).count() == 0
    docs = spark.createDataFrame([(1, "", "a"), (2, None, None)], docs.schema)
    allocation, targets = mixing.mix(docs)
    assert [(r.target, r.taken) for r in mixing.taken_rows(allocation, targets).collect()] == [(0.0, 0)] * 2


def test_large_repeat(spark):
    n, b = F.lit(10000).cast("long"), mixing._explode_count
    outer, inner = b(n)
    got = spark.range(1).select(F.explode(outer).alias("b")).select(F.explode(inner).alias("j"))
    assert [r.j for r in got.orderBy("j").collect()] == list(range(1, 10001))


def test_rows_that_differ_in_one_column(spark):
    """Rows with one id and text that differ elsewhere are rows of their own in the mixture; equal rows share copies."""
    data = [(1, "a b c", "s", x) for x in ("en", "fr", None)] + [(2, "a b c", "s", "en")] * 3
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, lang string").repartition(3)
    got = [tuple(r) for r in mixing.apply_mix(docs, share=2.0).collect()]
    assert sorted(got, key=str) == sorted(data * 2, key=str)
