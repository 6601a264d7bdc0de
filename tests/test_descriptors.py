"""Descriptor matches against all comparisons, and the filter against all triangles."""

import math
import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from paperloom.operators import descriptors

POINT = "kp int, x float, y float, desc binary"


def bits(a, b):
    return bin(int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).count("1")


def plain(page, template, ratio):
    out = []
    for kp, _, _, d in sorted(page):
        near = sorted((bits(d, e), k) for k, _, _, e in template)
        if near[0][0] < ratio * near[1][0]:
            out.append((kp, near[0][1], near[0][0]))
    return out


def images(rng):
    """Templates and pages; a page holds a template's points scaled and moved, with some bits changed, among others."""
    new = lambda: bytes(rng.randrange(256) for _ in range(61))
    templates = {t: [(k, rng.uniform(0, 900), rng.uniform(0, 600), new()) for k in range(rng.randint(20, 60))] for t in ("front", "back")}
    pages, true = {}, {}
    for p in range(4):
        t = ("front", "back")[p % 2]
        rows = []
        for k, x, y, d in templates[t][:40]:
            changed = bytearray(d)
            for _ in range(rng.randint(0, 40)):
                changed[rng.randrange(61)] ^= 1 << rng.randrange(8)
            wrong = k % 5 == 0
            true[p, k] = not wrong
            rows.append((k, rng.uniform(0, 900) if wrong else x * 0.5 + 30, rng.uniform(0, 600) if wrong else y * 0.5 + 40, bytes(changed)))
        rows += [(100 + k, rng.uniform(0, 900), rng.uniform(0, 600), new()) for k in range(300)]
        pages[p] = rows
    return templates, pages, true


def test_matches_and_filter(spark):
    templates, pages, true = images(random.Random(7))
    tp = spark.createDataFrame([(t, *r) for t, rows in templates.items() for r in rows] + [("one", 1, 0.0, 0.0, b"x"), ("front", None, 0.0, 0.0, b"")], f"template string, {POINT}").withColumn("page_id", F.lit("clash"))
    pp = spark.createDataFrame([(p, *r) for p, rows in pages.items() for r in rows], f"page_id int, {POINT}").withColumn("template", F.lit("clash"))
    asked = [(p, t) for p in pages for t in templates]
    pairs = spark.createDataFrame([*asked, (0, "one"), (9, "front"), (0, "none"), (0, "front")], "page_id int, template string").withColumn("kp", F.lit(1))
    got = {(r.page_id, r.template): r for r in descriptors.match(pp, tp, pairs, filtered=False).collect()}
    assert len(got) == 11 and all(got[k].n == 0 and got[k].matches == [] for k in ((0, "one"), (9, "front"), (0, "none")))
    for p, t in asked:
        want = plain(pages[p], templates[t], descriptors.RATIO)
        assert [(m.page_kp, m.template_kp, m.distance) for m in got[p, t].matches] == want and got[p, t].n == len(want)
    kept = {(r.page_id, r.template): {m.page_kp for m in r.matches} for r in descriptors.match(pp, tp, pairs).collect()}
    for p in pages:
        t = ("front", "back")[p % 2]
        before = {m.page_kp for m in got[p, t].matches}
        assert len(before) > 15 and kept[p, t] == {k for k in before if true.get((p, k))}


def test_filter_equals_all_triangles():
    """The drawn triangles find what all of them find."""
    rng = np.random.default_rng(2)
    for n in (3, 8, 20):
        dst = rng.uniform(0, 800, (n, 2))
        src = dst @ np.array([[0.6, -0.8], [0.8, 0.6]]) * 1.7 + 50  # turned, larger, moved
        off = rng.random(n) < 0.25
        off[:3] = False
        src[off] = rng.uniform(0, 800, (int(off.sum()), 2))
        most = max((votes(src, dst, t) for t in combinations(range(n), 3)), key=sum, default=[])
        assert descriptors.consistent(src, dst).tolist() == most and most == (~off).tolist()
    assert not descriptors.consistent(np.zeros((2, 2)), np.zeros((2, 2))).any() and not descriptors.consistent(np.zeros((5, 2)), np.zeros((5, 2))).any()


def votes(src, dst, t):
    side = lambda p, i, j: math.dist(p[i], p[j])
    pairs = [(t[0], t[1]), (t[1], t[2]), (t[2], t[0])]
    ratios = [side(src, *p) / side(dst, *p) for p in pairs]
    scale = sum(ratios) / 3
    (x1, y1), (x2, y2) = src[t[1]] - src[t[0]], src[t[2]] - src[t[0]]
    if max(abs(r - scale) for r in ratios) > 0.01 * scale or abs(x1 * y2 - x2 * y1) < 0.2 * side(src, *pairs[0]) * side(src, *pairs[2]):
        return [False] * len(src)
    return [all(abs(side(src, i, c) - scale * side(dst, i, c)) <= 0.01 * scale * max(side(dst, i, c), 1) for c in t) for i in range(len(src))]
