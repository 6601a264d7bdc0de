"""SimHash classes against a brute-force version."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from paperloom.llm import simhash
from paperloom.llm.components import connected_components


def plain_simhash(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for i in range(64):
            counts[i] += h >> i & 1
    return sum(1 << i for i in range(64) if counts[i] * 2 > len(grams))


def plain_components(rows, radius=2):
    ids = list(rows)
    parent = {i: i for i in range(len(ids))}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(ids[i][1] ^ ids[j][1]).count("1") <= radius:
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(ids):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [(d, f"{f:016x}", least.get(top(i))) for i, (d, f) in enumerate(ids)]


def texts():
    rng = random.Random(5)
    base = [" ".join(rng.choice("the a of tion Ing er an ES ü ñ".split()) + str(rng.randint(0, 40)) for _ in range(rng.randint(3, 150))) for _ in range(60)]
    out = [(i, t) for i, t in enumerate(base)]
    for k in range(120):  # near copies: one word changed, in chains
        w = out[rng.randrange(len(out))][1].split()
        w[rng.randrange(len(w))] = f"x{k}"
        out.append((100 + k, " \t".join(w)))
    out += [(900, None), (901, ""), (902, " \n "), (903, "one"), (904, "one two"), (905, "ONE"), (None, "one"), (7, base[3]), (7, base[3]), (950, "w " * 30000)]
    return out


def test_matches_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int").repartition(5)
    got = simhash.near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect()
    want = plain_components([(i, plain_simhash(t)) for i, t in rows])
    key = lambda r: tuple((x is None, x or 0) for x in r[:1]) + (r[1],)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    kept = simhash.keep_one_per_class(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({(c, f if c is None else "") for _, f, c in want})


def test_tiles_lose_no_link(spark):
    """Large groups are cut into tiles; results equal those of brute force."""
    rng = np.random.default_rng(1)
    hub = int(rng.integers(0, 2**63))
    f = {hub}
    while len(f) < 400:
        x = hub
        for _ in range(rng.integers(0, 7)):
            x ^= 1 << int(rng.integers(0, 63))
        f.add(x)
    f |= {int(x) for x in rng.integers(0, 2**63, 300)}
    df = spark.createDataFrame([(x,) for x in sorted(f)], "fp long")
    want = plain_components([(x, x) for x in f])
    want = {d: c for d, _, c in want}
    for tile in (16, 100, 8192):
        got = {r.node: r.root for r in connected_components(simhash.links(df, 2, tile)).collect()}
        assert {x: got.get(x, x) for x in f} == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.keep_one_per_class(docs).count() == 0


def test_components_of_long_chain(spark):
    e = spark.range(300).selectExpr("id a", "id + 1 b")
    got = {r.node: r.root for r in connected_components(e).collect()}
    assert got == {i: 0 for i in range(301)}
