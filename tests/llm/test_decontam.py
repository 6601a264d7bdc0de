"""Containment pairs against a brute-force version."""

import random
import re

from pyspark.sql import functions as F

from paperloom.llm import decontam

BREAK = " \t\n\x0b\f\r"


def shingles(t):
    for b in BREAK[1:]:
        t = (t or "").replace(b, " ")
    w = [x for x in t.lower().split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def fixture():
    rng = random.Random(8)
    word = lambda: rng.choice("ab cd Ef gh ñu of to in".split()) + str(rng.randint(0, 30))
    items = [(i, "\n".join(" ".join(word() for _ in range(rng.randint(3, 12))) for _ in range(3))) for i in range(30)]
    items += [(30, None), (31, ""), (32, "only four words here"), (33, "exactly five words in here"), (None, "a null id has shingles as well ok"), (34, "Three words item"), (35, "x")]
    docs = []
    for d in range(200):
        w = [word() for _ in range(rng.randint(0, 400))]
        for _ in range(rng.randint(0, 3)):
            p = (items[rng.randrange(34)][1] or "").split()
            for _ in range(rng.randint(0, 3)):  # some words changed: containment around the threshold
                if p:
                    p[rng.randrange(len(p))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = p
        docs.append((d, rng.choice([" ", "\n", " \t "]).join(w).upper()))
    docs += [(500, None), (501, ""), (None, items[0][1]), (3, docs[3][1]), (502, "x " * 20000 + items[1][1]), (503, "EXACTLY five words in here"), (504, "a null id has shingles as well ok"), (505, "Only four\twords here"), (506, "only four words here too"), (507, "three words item"), (508, "x")]
    return items, docs


def test_matches_brute_force(spark):
    items, docs = fixture()
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, item_id int, h int").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in decontam.contained(d, b).collect()}
    want = set()
    for i, t in items:
        q = shingles(t)
        for j, u in docs:
            if q and 5 * len(q & shingles(u)) >= 4 * len(q):
                want.add((j, i, len(q & shingles(u)), len(q)))
    assert {(505, 32), (507, 34), (508, 35)} <= {(j, i) for j, i, _, _ in got} and not {j for j, _, _, _ in got} & {506}
    assert got == want and len(want) > 50 and any(s < n for _, _, s, n in want)
    kept = decontam.remove_contaminated(d, b)
    assert kept.columns == d.columns
    bad = {(j, t) for j, t in docs for i, u in items if (q := shingles(u)) and 5 * len(q & shingles(t)) >= 4 * len(q)}
    assert sorted(str(tuple(r)[:2]) for r in kept.collect()) == sorted(str(x) for x in docs if x not in bad)


def test_empty(spark):
    items, docs = fixture()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontam.contained(d.limit(0), b).count() == 0
    assert decontam.contained(d, b.limit(0)).count() == 0
    assert decontam.remove_contaminated(d, b.limit(0)).count() == len(docs)


def test_hashes_are_filtered_before_they_are_exploded(spark):
    """With no broadcast at all, only hashes of the items' sketches reach a shuffle, and no join is by shingle."""
    d = spark.createDataFrame([(i, " ".join(f"w{i * 50 + k}" for k in range(300))) for i in range(200)] + [(900, " ".join(f"b{k}" for k in range(40)))], "doc_id long, text string").repartition(4)
    b = spark.createDataFrame([(1, " ".join(f"b{k}" for k in range(30)))], "item_id long, text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = decontam.contained(d, b)
        assert [(r.doc_id, r.shared) for r in found.collect()] == [(900, 26)]
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" in plan and not re.search(r"(?:shingles?|found)#\d+ =|= (?:shingles?|found)#", plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    keep, _ = decontam.sketch_filter(spark.createDataFrame([(1, 5, 2, h) for h in range(0, 10**6, 997)], "item_id long, need long, size_class int, h long"))
    passed = spark.range(10**6).where(keep(F.col("id")))
    assert passed.where("id % 997 = 0").count() == -(-(10**6) // 997) and passed.count() < 10**5
