"""Exact top-k against a brute-force version."""

import datetime
import decimal
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import knn


def plain(rows, k=20):
    fine = [(i, n, [math.floor(64 * x) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, n, q in fine:
        if i is not None and i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, x)), j is None, j or 0, m) for j, m, x in fine if m != n)
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j, _) in enumerate(scored[:k])]
    return sorted(out, key=str)


def vectors(n=600, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim)) * 2
    rows = [(i, [float(np.float32(x)) for x in centres[rng.integers(6)] + rng.normal(size=dim) * 0.2]) for i in range(n)]
    for i in range(100, 260):  # one vector that many rows share
        rows[i] = (i, rows[100][1])
    return rows


@pytest.mark.parametrize("pivots,group,block", [(None, 2048, 8192), (12, 4, 100), (1, 3, 7000), (40, 8, 50)])
def test_matches_brute_force(spark, pivots, group, block):
    rows = vectors() + [(2000, None), (2001, [1.0, None] + [0.0] * 6), (2020, [float("nan")] * 8), (2040, [float("inf")] * 8), (None, [0.5] * 8), (40, [0.5] * 8), (40, [0.5] * 8)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, cell int").repartition(5)
    got = knn.top_k(df, F.col("vec_id") % 20 == 0, pivots=pivots, group_queries=group, block_rows=block).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_pruning_on_clustered_vectors(spark):
    """On clustered vectors a query meets a small part of all rows, and the result is that of all pairs."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 3
    rows = [(i, [float(np.float32(x)) for x in centres[i % 40] + rng.normal(size=16) * 0.1]) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    asks = F.col("vec_id") % 20 == 0
    _, visits = knn.search(df, asks, pivots=80, block_rows=150, group_queries=40)
    met = visits.agg(F.sum("rows")).first()[0]
    print(f"{met} of {200 * 4000} pairs")
    assert met < 0.4 * 200 * 4000
    assert sorted(map(tuple, knn.top_k(df, asks, pivots=80, block_rows=150, group_queries=40).collect()), key=str) == plain(rows)


def test_blocks():
    """Blocks are bounded, every cell has its own or shares one, and a large cell is cut."""
    rng = np.random.default_rng(2)
    p, counts = rng.normal(size=(30, 4)), {i: 5 + i for i in range(30)} | {7: 1000}
    plan = knn.plan_blocks(p, counts, 100)
    assert plan[7][1] == 10 and set(plan) == set(counts)
    load = {}
    for c, (first, parts) in plan.items():
        for b in range(first, first + parts):
            load[b] = load.get(b, 0) + counts[c] / parts
    assert max(load.values()) <= 100 and sorted(load) == list(range(len(load)))


@pytest.mark.parametrize("kind,make", [("string", str), ("decimal(9,2)", decimal.Decimal), ("date", lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(i))])
def test_other_ids(spark, kind, make):
    rows = [(make(i), [float(i % 7), 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, f"id {kind}, embedding array<double>")
    got = knn.top_k(df, F.col("id") == F.lit(make(3)).cast(kind), id_col="id", k=5).collect()
    want = sorted((-(64 * 64 * (3 * (i % 7) + 1)), make(i)) for i in range(60) if i != 3)[:5]
    assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == want


def test_small_and_odd(spark):
    schema = "vec_id long, embedding array<double>"
    assert knn.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0
    rows = [(0, [1.0, 2.0]), (1, [3.0]), (2, []), (20, [1e300, 1.0])]
    got = knn.top_k(spark.createDataFrame(rows, schema), F.col("vec_id") % 20 == 0).collect()
    assert len(got) == 6
    assert sorted((r.query_id, r.vec_id, r.score) for r in got if r.query_id == 0) == [(0, 1, 64 * 192), (0, 2, 0), (0, 20, 2**63 - 1)]
