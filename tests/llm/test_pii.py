"""Base spans against plain regular expressions; the added spans' model and their rules."""

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from paperloom.llm import pii
from paperloom.llm.queries import pii_digest

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(t):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def texts():
    rng = random.Random(4)
    bits = ["a@b.co", "x.y%z@mail-1.example.com", "@", "a@b", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "0010.000255.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (073) 555-8658", "+49", "+1", "é", "😀", " ", "-", ".", "word", "12", "2020-01-02", "tel 555 123 4567", "j.doe [at] host.org", 'token = "' + "0b96a8c8" * 5 + '"', "\n", "%", "a.b@c.d%e@f.g"]
    rand = ["".join(rng.choice("ab1 2.+-@%()0é😀") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    return [rng.choice([" ", ""]).join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(400)] + rand + [None, "", "a" * 2000, "1" * 2000, "1.2." * 500, "x@y.z " * 3000, "+" + "(" * 5000]


def test_base_equals_plain(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, base int").repartition(6)
    got = {r.doc_id: r for r in pii_digest(docs).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = plain(t)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in want) for x in PLAIN), t
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest(), t
        spans = [x.split(":") for x in r.spans.split(",")] if r.spans else []
        mine = [(k, int(s), int(e)) for k, s, e in spans]
        assert set(want) <= set(mine) and len(mine) == len(set(mine))
        assert mine == sorted(mine, key=lambda x: (pii.KINDS.index(x[0]), x[1]))
        extra = sorted((s, e) for k, s, e in set(mine) - set(want))
        assert all(e <= s2 for (_, e), (s2, _) in zip(extra, extra[1:]))
        assert all(e <= s2 or e2 <= s for s, e in extra for _, s2, e2 in want)


def test_added_spans(spark):
    token = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6"
    rows = [(0, f'and the token = "{token}" of'), (1, "please call 555-123-4567 today"), (2, "write to j.doe [at] host.org now"), (3, "in 2019-01-02 about 12 345 678 km and 1990"), (4, "a very-long-hyphenated-compound-word-here and onthewholeitgoesonandon")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(s.kind, rows[r.doc_id][1][s.start : s.end]) for s in r.added] for r in pii.find(docs, ["doc_id"]).collect()}
    assert got[0] == [("secret", token)] and got[1][0][1] == "555-123-4567" and got[2] == [("email", "j.doe [at] host.org")]
    assert got[3] == [] and got[4] == []
    out = pii.find(docs, ["doc_id", "text"]).select(pii.redact(F.col("text"), F.concat("base", "added")).alias("r")).collect()
    assert out[0].r == 'and the token = "<secret>" of'


def test_very_long_texts(spark):
    """Runs that would make a search try again from each character."""
    rows = [(0, "a" * 300_000), (1, "1" * 100_000), (2, "1.2." * 20_000), (3, "+" + "(" * 50_000)]
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (0, 0, 0, 0), 1: (0, 0, 0, 0), 2: (0, 20_000 // 2, 0, 0), 3: (0, 0, 0, 0)}


def test_very_many_spans(spark):
    """160,000 phones in one text; names of kept columns don't clash with the operator's own."""
    text = "call +1 555 123 4567 or 555-123-4567, " * 80_000
    docs = spark.createDataFrame([(1, text, 7, "x"), (2, "x@y.zz", 8, "y")], "doc_id long, text string, cands int, g0 string")
    model = pii.fit(spark)
    t = time.perf_counter()
    got = {r.doc_id: r for r in pii.find(docs, ["doc_id", "cands", "g0"], model=model).collect()}
    assert time.perf_counter() - t < 90
    assert (got[1].cands, got[1].g0, len(got[1].base), len(got[1].added)) == (7, "x", 80_000, 80_000) and len(got[2].base) == 1 and got[2].added == []


def test_empty(spark):
    assert pii_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chain_of_overlaps(spark):
    """Two phone numbers bridged by one digit run that scores between them: both are kept, the run is not."""
    text = "so 555-123-4567 555-765-4321 km"
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    names = list(pii.features(F.col("c")))
    phone, unit = names.index("kind_phone"), names.index("unit")
    model = (0.0, [(phone, {True: (unit, {True: 1.0, False: 3.0}), False: (phone, {False: 2.0})})]), {"email": 9.0, "phone": 0.5, "account": 0.5, "secret": 9.0}
    added = pii.find(docs, ["doc_id"], model=model).first().added
    assert [(s.kind, text[s.start : s.end]) for s in added] == [("phone", "555-123-4567"), ("phone", "555-765-4321")]


def independent(seed):
    """Texts that share neither words nor templates with the training snippets: (kind, text, span)."""
    rng = random.Random(seed)
    of = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    digit, low = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    every = low + low.upper() + digit
    kinds = {
        "email": lambda: f"{of(low, 5)}{of(digit, 2)}{rng.choice([' [at] ', '(at)', ' (AT) '])}{of(low, 7)}{rng.choice(['.', ' [dot] '])}{rng.choice(['net', 'org', 'de'])}",
        "phone announced": lambda: f"{of(digit, 3)}-{of(digit, 3)}-{of(digit, 4)}",
        "phone bare": lambda: rng.choice([f"({of(digit, 3)}) {of(digit, 3)}-{of(digit, 4)}", f"{of(digit, 3)}-{of(digit, 3)}-{of(digit, 4)}", f"{of(digit, 3)}.{of(digit, 3)}.{of(digit, 4)}"]),
        "account announced": lambda: of("123456789", 1) + of(digit, rng.choice([8, 9, 10, 11])),
        "secret hex": lambda: of("0123456789abcdef", rng.choice([32, 40, 48, 64])),
        "secret mixed": lambda: of(every, rng.choice([30, 36, 40])),
        "secret base64": lambda: of(every + "+/", 43) + "=",
        "secret prefixed": lambda: rng.choice(["sk_live_", "pk_live_", "gho_", "xoxp-"]) + of(every, 28),
        "secret access": lambda: "AKIA" + of(low.upper() + digit, 16),
    }
    lead = {"phone announced": ["fax ", "whatsapp: ", "my cell is "], "account announced": ["patient ", "insurance number ", "konto "]}
    say = lambda: " ".join(of(low, rng.randint(2, 9)) for _ in range(rng.randint(4, 9)))
    for name, make in kinds.items():
        for _ in range(100):
            left, body = say() + " " + rng.choice(lead.get(name, [""])), make()
            yield name, f"{left}{body}{rng.choice([' ', ', ', '. '])}{say()}", (len(left), len(left) + len(body))
    clean = [
        lambda: f"{of('123456789', 1)} {of(digit, 3)} {of(digit, 3)} km", lambda: f"{of(digit, 2)}.{of(digit, 3)}.{of(digit, 3)}", lambda: f"20{of(digit, 2)}-0{of('123456789', 1)}-1{of(digit, 1)}", lambda: "-".join(of(low, 5) for _ in range(5)),
        lambda: "/".join(of(low, 6) for _ in range(5)), lambda: of(low, 30), lambda: "".join(of(low, 5).title() for _ in range(5)), lambda: "_".join(of(low, 6) for _ in range(4)) + "_" + of(digit, 2), lambda: of(digit, 6), lambda: "v" + ".".join(of(digit, 1) for _ in range(3)),
    ]
    for _ in range(400):
        yield "clean", f"{say()} {rng.choice(clean)()} {say()}", None


def test_recall_of_added_spans(spark):
    """Recall of each added kind on independent texts is 0.9 or more, and few clean texts get a span."""
    rows = list(independent(77))
    docs = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(rows)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: [(s.start, s.end) for s in [*r.base, *r.added]] for r in pii.find(docs, ["doc_id"]).collect()}
    found, total = {}, {}
    for i, (name, _, span) in enumerate(rows):
        total[name] = total.get(name, 0) + 1
        hit = any(s <= span[0] and e >= span[1] for s, e in got[i]) if span else bool(got[i])
        found[name] = found.get(name, 0) + hit
    rates = {k: found[k] / total[k] for k in total}
    print(rates)
    assert rates.pop("clean") <= 0.05 and min(rates.values()) >= 0.9, rates
