"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base patterns give spans that always count. High-recall generators propose further spans, which may overlap; boosted
trees score each by format and context features; a kind's calibrated threshold selects, and of overlapping
proposals the best is kept. The trees are fitted on a fixed number of generated, labelled snippets.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.llm.common import stage

#: Kinds in their order. The base patterns have the first four; proposals may have any.
KINDS = ("email", "ip", "card", "phone", "account", "secret")
LOCAL = r"A-Za-z0-9._%+-"
#: A pattern that starts with a run of characters can only match at the run's start, or where the last match ended;
#: saying so, and not giving characters back, keeps the search linear in the text without changing what it finds.
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Generators: kind and pattern. They need not be precise.
GENERATORS = (
    ("email", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++ ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]++(?: ?(?:[\[(] ?(?:dot|DOT) ?[\])]|\.) ?[A-Za-z0-9-]++)++"),
    ("phone", r"(?<![0-9+])\(?[0-9]{2,4}\)?[ .-][0-9]{3}[ .-][0-9]{3,4}(?![0-9])"),
    ("account", r"[0-9](?:[ -]?[0-9])++"),
    ("secret", r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+"),
)
#: Text that a cheap search must find before a pattern is tried at all.
NEEDS = {"email": "@", "phone": "+"}
#: Characters of context to the left and right that features see.
LEFT, RIGHT = 32, 12
#: Words that announce a kind, matched without case in the left context.
CUES = {
    "email": r"mail|contact|reach|write|schreib|correo|courriel",
    "phone": r"phone|call|tel|mobile|fax|cell|anruf|llam|appel|whatsapp",
    "account": r"account|iban|passport|ssn|licen[cs]e|insurance|customer|patient|konto|cuenta|compte",
    "secret": r"token|secret|passw|api|key|auth|credential",
}
BLOCK = 256


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def with_matches(df: DataFrame, text: str, pattern: str, out: str, kind: str, need: str | None = None) -> DataFrame:
    """df with the column `out`: the leftmost non-overlapping matches as structs (kind, start, end, txt, left, right).

    Offsets are sums of the lengths of what lies between matches and of matches, by blocks, so that a text with
    very many matches stays cheap; they count code points.
    """
    t = F.col(text) if need is None else F.when(F.contains(F.col(text), F.lit(need)), F.col(text)).otherwise(F.lit(""))
    df = df.withColumn(f"{out}_m", F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
    df = df.withColumn(f"{out}_p", F.when(F.size(f"{out}_m") > 0, F.split(F.col(text), pattern, -1)).otherwise(F.array(F.lit(""))))
    m, p = F.col(f"{out}_m"), F.col(f"{out}_p")
    df = df.withColumn(f"{out}_d", F.transform(m, lambda x, i: F.length(x) + F.length(p[i])))
    d = F.col(f"{out}_d")
    blocks = F.when(F.size(d) > 0, F.sequence(F.lit(0), F.expr(f"(size({out}_d) - 1) div {BLOCK}").cast("int"))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(f"{out}_b", F.transform(blocks, lambda c: _sum(F.slice(d, c * BLOCK + 1, F.lit(BLOCK)))))
    b = F.col(f"{out}_b")
    df = df.withColumn(f"{out}_o", F.transform(b, lambda x, c: _sum(F.slice(b, F.lit(1), c))))

    def span(x: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        # named twice: a column that is named once only would be put here as an expression and computed for each match
        before = F.when(block < F.size(f"{out}_o"), F.col(f"{out}_o")[block])
        start = before + _sum(F.slice(d, block * BLOCK + 1, i % BLOCK)) + F.length(p[i])
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(x)).alias("end"), x.alias("txt"), F.right(p[i], F.lit(LEFT)).alias("left"), F.left(p[i + 1], F.lit(RIGHT)).alias("right"))

    df = df.withColumn(out, F.transform(m, span))
    return df.drop(*[f"{out}_{x}" for x in "mpdbo"])


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits(x)).between(16, 19) & F.call_function("luhn_check", digits(x))
    if kind == "phone":
        return F.length(digits(x)).between(8, 15)
    return F.lit(True)


def _valid_span(kind: str):
    return lambda x: valid(kind, x["txt"])


def features(c: Column) -> dict[str, Column]:
    """Yes-or-no features of a proposed span's format and context."""
    t, n = c["txt"], F.length(digits(c["txt"]))
    cue = {f"cue_{k}": F.lower(c["left"]).rlike(v) for k, v in CUES.items()}
    return {
        **{f"kind_{k}": c["kind"] == k for k in ("email", "phone", "account", "secret")}, **cue,
        "digits_7": n >= 7, "digits_9": n >= 9, "digits_10": n == 10, "digits_12": n >= 12, "digits_16": n >= 16, "luhn": F.coalesce(F.call_function("luhn_check", digits(t)), F.lit(False)) & (n >= 12),
        "grouped": t.rlike(r"[0-9][ -][0-9]"), "thousands": t.rlike(r"^[0-9]{1,3}(?:[ .][0-9]{3})+$"), "date": t.rlike(r"^(?:19|20)[0-9]{2}[ -][0-9]{1,2}[ -][0-9]{1,2}$"),
        "last_4": t.rlike(r"[ .-][0-9]{4}$"), "parted": t.rlike(r"^\(|^[0-9]+([.-])[0-9]+\1"), "social": t.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
        "brackets": t.rlike(r"[\[(]"), "hex": t.rlike(r"^[0-9a-fA-F]{24,}$"), "mixed": t.rlike("[0-9]") & t.rlike("[A-Za-z]"), "letters": t.rlike(r"^[A-Za-z_-]+$"),
        "cases": t.rlike("[a-z]") & t.rlike("[A-Z]") & t.rlike("[0-9]"), "turns": F.regexp_count(t, F.lit("[A-Za-z][0-9]|[0-9][A-Za-z]|[a-z][A-Z]|[A-Z][a-z]")) >= 6, "long_word": t.rlike("[a-z]{7,}|[A-Z]{7,}"), "parts": t.rlike("[/_-][^/_-]+[/_-][^/_-]+[/_-]"), "key_prefix": t.rlike(r"^(?:[a-z]{2}_(?:live|test)_|gh[a-z]_|AKIA|xox[a-z]-|AIza|eyJ)"),
        "assigned": c["left"].rlike(r"[=:] ?[\"']?$"), "quoted": c["left"].rlike(r"[\"']$") & c["right"].rlike(r"^[\"']"),
        "joined": c["left"].rlike(r"[A-Za-z0-9./]$") | c["right"].rlike(r"^[A-Za-z0-9/]"), "unit": c["right"].rlike(r"^ ?(?:%|€|\$|km|kg|years|Jahre|USD|EUR)"),
    }


def snippets(n: int, seed: int) -> list[tuple[int, str, int, int]]:
    """Generated training texts: (number, text, start, end) with the span that is personal; start -1 if none is."""
    r = random.Random(seed)
    of = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    d = lambda k: of("0123456789", k)
    lower = "abcdefghijklmnopqrstuvwxyz"
    alnum = lower + lower.upper() + "0123456789"
    word = lambda: r.choice("the of tion nd here lich und que para avec les stand order about page in from".split())
    cue = {"email": ["mail ", "contact: ", "write to "], "phone": ["call ", "tel. ", "phone: ", "mobile "], "account": ["account ", "passport no. ", "IBAN: ", "ssn ", "customer "], "secret": ["token = \"", "api_key: ", "password=", "secret = '"]}
    out = []
    for i in range(n):
        kind, good = r.choice(list(cue)), r.random() < 0.5
        # formats that are personal by themselves, and those that only a cue makes so
        sure = True
        if kind == "email":
            body = f"{word()}.{word()}{r.choice([' [at] ', '(at)', ' (at) ', '[at]'])}{word()}{r.choice(['.', ' [dot] ', '(dot)'])}com" if good else f"{word()} at {word()}.com"
        elif kind == "phone":
            body = r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}"]) if good else r.choice([f"{d(3)} {d(3)} {d(3)}", f"2019-{d(2)}-{d(2)}", f"{d(2)} {d(3)} {d(3)}", f"{d(2)}.{d(3)}.{d(3)}", f"{d(3)}.{d(3)}.{d(3)}"])
        elif kind == "account":
            body = r.choice([d(r.randint(8, 13)), d(r.randint(8, 13)), d(r.randint(8, 13)), f"{d(3)}-{d(2)}-{d(4)}"]) if good else r.choice([d(4), d(2), f"{d(1)} {d(3)} {d(3)}", f"20{d(2)}-0{r.randint(1, 9)}-1{d(1)}", d(r.randint(5, 12))])
            sure = body.count("-") == 2
        else:
            keys = [of("0123456789abcdef", r.choice([32, 40, 64])), of("0123456789ABCDEF", r.choice([32, 40])), of(alnum, r.randint(24, 48)), of(alnum + "+/", r.choice([43, 63, 87])) + "=", r.choice(["sk_live_", "pk_test_", "ghp_", "xoxb-", "AIza"]) + of(alnum, r.randint(24, 36)), "AKIA" + of(lower.upper() + "0123456789", 16)]
            slugs = ["".join(word() for _ in range(6)), "-".join(word() for _ in range(6)), "=" * 24, "_" * 30, "/".join(word() + r.choice(["", d(2)]) for _ in range(6)), f"20{d(2)}/0{d(1)}/1{d(1)}/" + "-".join(word() for _ in range(4)), "_".join(word().title() for _ in range(5)) + d(2), "".join(word().title() for _ in range(6)), "-".join(word() for _ in range(4)) + "-" + d(4)]
            body = r.choice(keys) if good else r.choice(slugs)
        # most personal data is announced, and some other numbers are as well
        lead = r.choice(cue[kind]) if r.random() < (0.7 if good and kind != "email" else 0.1) else ""
        personal = good and (sure or bool(lead))
        left = " ".join(word() for _ in range(r.randint(3, 8))) + " " + lead
        out.append((i, left + body + (lead[-1] if lead.endswith(("\"", "'")) else "") + r.choice([" ", ". ", ", ", " km ", " "]) + word(), len(left) if personal else -1, len(left) + len(body)))
    return out


def boost(rows: list[tuple[tuple[bool, ...], bool]], rounds: int, rate: float = 0.4) -> tuple[float, list]:
    """Gradient boosting of depth-two trees for the logistic loss: the prior, and trees (feature, {side: (feature, {side: value})})."""
    shape: dict[tuple[bool, ...], list[int]] = {}
    for x, y in rows:
        shape.setdefault(x, [0, 0])[y] += 1
    data = [(x, n0 + n1, n1) for x, (n0, n1) in sorted(shape.items())]
    pos, count = sum(p for _, _, p in data), sum(n for _, n, _ in data)
    prior = math.log((pos + 1) / (count - pos + 1))
    score, trees = [prior] * len(data), []

    def leaf(g: float, h: float) -> float:
        return g / (h + 1.0)

    def split(part: list[int], grad: list[float], hess: list[float]) -> tuple[int, dict]:
        best = (-1.0, 0, {})
        for f in range(len(data[0][0])):
            s = {True: [0.0, 0.0], False: [0.0, 0.0]}
            for i in part:
                side = s[data[i][0][f]]
                side[0] += grad[i]
                side[1] += hess[i]
            gain = sum(g * g / (h + 1.0) for g, h in s.values())
            if gain > best[0] + 1e-12:
                best = (gain, f, {k: rate * leaf(*v) for k, v in s.items()})
        return best[1], best[2]

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-v)) for v in score]
        grad = [y - n * q for (_, n, y), q in zip(data, p)]
        hess = [n * q * (1 - q) for (_, n, _), q in zip(data, p)]
        top, _ = split(list(range(len(data))), grad, hess)
        tree = (top, {k: split([i for i, (x, _, _) in enumerate(data) if x[top] == k], grad, hess) for k in (True, False)})
        trees.append(tree)
        score = [v + tree[1][x[top]][1].get(x[tree[1][x[top]][0]], 0.0) for v, (x, _, _) in zip(score, data)]
    return prior, trees


def predict_one(model: tuple[float, list], x: tuple[bool, ...]) -> float:
    return model[0] + sum(t[x[f]][1].get(x[t[x[f]][0]], 0.0) for f, t in model[1])


class _Numbered:
    """Elements of an array column by number."""

    def __init__(self, array: Column):
        self.array = array

    def __getitem__(self, k: int) -> Column:
        return F.get(self.array, F.lit(k))


def score(model: tuple[float, list], f: list[Column] | _Numbered) -> Column:
    """The model's score as one expression over feature columns."""
    out = F.lit(model[0])
    for top, sides in model[1]:
        leaf = {k: F.when(f[g], F.lit(v.get(True, 0.0))).otherwise(F.lit(v.get(False, 0.0))) for k, (g, v) in sides.items()}
        out = out + F.when(f[top], leaf[True]).otherwise(leaf[False])
    return out


def propose(df: DataFrame, text: str) -> DataFrame:
    """df with the column cands: all proposals of all generators."""
    for i, (kind, pattern) in enumerate(GENERATORS):
        df = with_matches(df, text, pattern, f"g{i}", kind)
    return df.withColumn("cands", F.concat(*[f"g{i}" for i in range(len(GENERATORS))])).drop(*[f"g{i}" for i in range(len(GENERATORS))])


_FITTED: dict[tuple, tuple] = {}


def fit(spark: SparkSession, n: int = 4000, rounds: int = 30, precision: float = 0.98, seed: int = 11) -> tuple[tuple[float, list], dict[str, float]]:
    """(model, thresholds) from n generated snippets, through the same generators and features that texts take.

    Two thirds fit the trees. On the others each kind's threshold is set: the least score from which on the precision
    is reached; a kind that never reaches it proposes nothing. Kept per parameters, as it depends on nothing else.
    """
    args = (n, rounds, precision, seed)
    if args not in _FITTED:
        made = spark.createDataFrame(snippets(n, seed), "i int, text string, s int, e int")
        c = propose(made, "text").select("i", "s", "e", F.explode(F.when(F.size("cands") > 0, F.col("cands"))).alias("c"))
        names = list(features(F.col("c")))
        rows = c.select("i", F.col("c.kind").alias("kind"), ((F.col("s") >= 0) & (F.col("c.start") < F.col("e")) & (F.col("c.end") > F.col("s")) & (F.col("c.start") <= F.col("s") + 2) & (F.col("c.end") >= F.col("e") - 1)).alias("y"), F.array(*features(F.col("c")).values()).alias("x")).collect()  # a few for each of n snippets
        assert not rows or len(rows[0].x) == len(names)
        model = boost([(tuple(r.x), r.y) for r in rows if r.i % 3], rounds)
        limits = {}
        for kind in sorted({k for k, _ in GENERATORS}):
            held = sorted(((predict_one(model, tuple(r.x)), r.y) for r in rows if r.i % 3 == 0 and r.kind == kind), reverse=True)
            good = [s for k, (s, _) in enumerate(held) if sum(y for t, y in held if t >= s) >= precision * sum(t >= s for t, _ in held)]
            limits[kind] = min(good, default=math.inf) - 1e-9
        _FITTED[args] = (model, limits)
    return _FITTED[args]


def find(docs: DataFrame, keep: list[str], text: str = "text", model: tuple | None = None) -> DataFrame:
    """The columns `keep` of docs with base and added: arrays of spans (kind, start, end), in order.

    A null text counts as empty. base has the spans of the four patterns that pass their checks; added has the proposals
    that the trees select and that overlap no base span and no selected proposal that scores higher (then is longer,
    then starts earlier). Whole texts are read, once, where they lie; one row in, one row out. Proposals are resolved by runs of overlapping
    spans, so a text may hold any number of them. Columns in keep may have any names; base and added are put beside them.
    """
    trees, limits = model or fit(docs.sparkSession)
    names = [f"k{i}" for i in range(len(keep))]
    df = docs.select(*[F.col(k).alias(n) for k, n in zip(keep, names)], F.coalesce(F.col(text), F.lit("")).alias("t"))
    for kind, pattern in BASE.items():
        df = with_matches(df, "t", pattern, f"b_{kind}", kind, NEEDS.get(kind))
    bare = lambda xs: F.transform(xs, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    df = df.withColumn("base", bare(F.concat(*[F.filter(f"b_{k}", _valid_span(k)) for k in BASE])))
    df = propose(df.drop(*[f"b_{k}" for k in BASE]), "t").drop("t")
    found = stage(df.withColumn("row", F.monotonically_increasing_id()), "proposals")  # rows keep their numbers
    limit = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])
    c = found.select("row", F.explode(F.when(F.size("cands") > 0, F.col("cands"))).alias("c"))
    # features once for each proposal; the trees read them by number
    c = c.withColumn("f", F.array(*[F.coalesce(f, F.lit(False)) for f in features(F.col("c")).values()]))
    c = c.select("row", "c", F.explode(F.array(score(trees, _Numbered(F.col("f"))))).alias("score"))  # exploded, as else the filter on it takes all expressions along
    good = c.where(F.col("score") >= limit[F.col("c.kind")]).select("row", F.lit(False).alias("fixed"), "score", "c.kind", "c.start", "c.end")
    fixed = found.select("row", F.explode(F.when(F.size("base") > 0, F.col("base"))).alias("c")).select("row", F.lit(True).alias("fixed"), F.lit(0.0).alias("score"), "c.kind", "c.start", "c.end")
    # runs of spans that overlap, each resolved by itself
    in_text = W.partitionBy("row").orderBy("start", "end", "kind")
    reach = F.max("end").over(in_text.rowsBetween(W.unboundedPreceding, -1))
    runs = good.union(fixed).withColumn("new", F.when(F.col("start") < reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(in_text.rowsBetween(W.unboundedPreceding, 0)))
    span = F.struct("fixed", "score", (F.col("end") - F.col("start")).alias("n"), (-F.col("start")).alias("early"), "kind", "start", "end")
    runs = runs.groupBy("row", "run").agg(F.reverse(F.array_sort(F.collect_list(span))).alias("spans"), F.max(~F.col("fixed")).alias("some")).where("some")
    # base spans come first and stay, then the best; a proposal is taken if it overlaps none that was taken before
    meets = lambda c, o: (o["start"] < c["end"]) & (o["end"] > c["start"])
    take = lambda taken, c: F.when(~c["fixed"] & F.exists(taken, lambda o: meets(c, o)), taken).otherwise(F.concat(taken, F.array(c)))
    taken = F.aggregate("spans", F.filter("spans", lambda c: F.lit(False)), take)
    chosen = runs.select("row", F.explode(F.filter(taken, lambda c: ~c["fixed"])).alias("c"))
    added = chosen.groupBy(F.col("row").alias("a_row")).agg(F.array_sort(F.collect_list(F.struct("c.start", "c.end", "c.kind"))).alias("added"))
    out = found.join(added, F.col("row") == F.col("a_row"), "left")
    none = F.array().cast(found.schema["base"].dataType)
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keep)], "base", F.coalesce(bare(F.col("added")), none).alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end by kind, then start, comma-joined."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(rank(s).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span, overlapping ones merged, replaced by its kind in angle brackets. Null stays null."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substr(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        out = F.when(s["start"] >= a["at"], F.concat(a["out"], gap, F.lit("<"), s["kind"], F.lit(">"))).otherwise(a["out"])
        return F.struct(out.alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    return F.when(text.isNotNull(), F.aggregate(by_start, state, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text)))))
