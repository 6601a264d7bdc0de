"""Fuzzy lookup of names in a gazetteer of keys ordered by popularity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions.text import turkic_split
from paperloom.staging import stage

# Greatest edit distance of each kind, candidates kept, and keys that a query expands to.
MAX_DISTANCE = {"name": 3, "surname": 3, "patronymic": 4}
LIMIT, EXPANSION = 20, 5
# Second words of Turkic patronymics of men; the others are of women.
TURKIC_MALE = ("ОГЛЫ", "ОГЛУ", "УЛЫ", "УУЛУ")


def load(rows: DataFrame) -> DataFrame:
    """rows (word, gender text, in order id) as the gazetteer (id, key, gender): the first id and last gender of each key."""
    code = F.when(F.col("gender") == "MALE", 1).when(F.col("gender") == "FEMALE", 2).otherwise(0)
    return rows.groupBy(F.col("word").alias("key")).agg(F.min("id").alias("id"), F.max_by(code, "id").alias("gender"))


def gender_name(code: Column) -> Column:
    return F.when(code == 1, "MALE").when(code == 2, "FEMALE").otherwise("UNKNOWN")


def candidates(queries: DataFrame, gazetteer: DataFrame, k: int = 3, expansion: int | None = EXPANSION, limit: int = LIMIT) -> DataFrame:
    """(word, id, key, gender, distance, score, n) of each distinct word's nearest keys; score is k + 1 less the distance.

    Of k + 1 pieces that a key is cut into, one is in the word unharmed if they are k edits apart, shifted by at most
    k; so key pieces join word substrings on equality (no pair of a word and a key without a common piece is made),
    and short keys, whose pieces may be empty, join by length. Pairs are then verified. `expansion` keeps the nearest
    keys by distance and id; None keeps all within `limit`.
    """
    words = queries.select("word").where("word is not null").distinct()
    g = gazetteer.select("id", "key", "gender", F.length("key").alias("g_len"))
    pieces = g.where(F.col("g_len") > k).select("id", "key", "gender", "g_len", F.explode(_cut("key", k)).alias("p")).select("id", "key", "gender", "g_len", F.col("p.at").alias("at"), F.col("p.piece").alias("piece"))
    w = words.withColumn("w_len", F.length("word"))
    # a key's length lies within k of the word's; its pieces' places and lengths follow from it
    lens = w.withColumn("k_len", F.explode(F.sequence(F.greatest(F.col("w_len") - k, F.lit(k + 1)), F.greatest(F.col("w_len") + k, F.lit(k + 1)))))
    grams = lens.withColumn("c", F.explode(_cut_places("k_len", k))).withColumn("s", F.explode(F.sequence(F.greatest(F.col("c.at") - k, F.lit(0)), F.col("c.at") + k)))
    grams = grams.select("word", "k_len", F.col("c.at").alias("g_at"), F.substr("word", F.col("s") + 1, F.col("c.n")).alias("gram"), F.col("c.n").alias("n")).where("length(gram) = n").select("word", "k_len", "g_at", "gram").distinct()
    long_pairs = grams.join(pieces, (grams.gram == pieces.piece) & (grams.k_len == pieces.g_len) & (grams.g_at == pieces["at"])).select("word", "id", "key", "gender")
    short = g.where(F.col("g_len") <= k)
    short_pairs = w.where(F.col("w_len") <= 2 * k).withColumn("k_len", F.explode(F.sequence(F.greatest(F.col("w_len") - k, F.lit(0)), F.lit(k)))).join(short, F.col("k_len") == F.col("g_len")).select("word", "id", "key", "gender")
    pairs = long_pairs.union(short_pairs).distinct()
    d = pairs.withColumn("distance", F.levenshtein("word", "key", k)).where("distance >= 0")
    n = F.row_number().over(W.partitionBy("word").orderBy("distance", "id"))
    return d.withColumn("score", k + 1 - F.col("distance")).withColumn("n", n).where(F.col("n") <= min(limit, expansion or limit))


def _cut_places(length: str, k: int) -> Column:
    """Places of the k + 1 pieces of a word of this length: struct(at, n)."""
    n = F.col(length)
    edge = lambda i: F.floor(i * n / (k + 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.struct(edge(i).alias("at"), (edge(i + 1) - edge(i)).alias("n")))


def _cut(word: str, k: int) -> Column:
    n = F.length(word)
    edge = lambda i: F.floor(i * n / (k + 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.struct(edge(i).alias("at"), F.substr(F.col(word), edge(i) + 1, edge(i + 1) - edge(i)).alias("piece")))


def pick(cands: DataFrame, k: int = 3, lower: bool = False) -> DataFrame:
    """One answer for each word: (word, value, gender, score).

    The best candidate, unless one at the next distance is over 5000 times more popular; an exact hit has score 1, a
    mere neighbour of both kinds 0.75. lower takes off 0.25.
    """
    tier = lambda d: F.min(F.when(F.col("score") == k + 1 - d, F.struct("id", "key", "gender")))
    a = cands.groupBy("word").agg(F.min_by(F.struct("key", "gender", "score"), "n").alias("top"), tier(0).alias("l1"), tier(1).alias("l2"), tier(2).alias("l3"))
    base = F.col("top.score") / F.lit(float(k + 1))

    def answer(x: str, score: Column) -> Column:
        return F.struct(F.col(f"{x}.key").alias("value"), F.col(f"{x}.gender").alias("gender"), score.alias("score"))

    both, far = F.col("l1").isNotNull() & F.col("l2").isNotNull(), F.col("l2").isNotNull() & F.col("l3").isNotNull()
    best = (
        F.when(both & (F.col("l1.id") > 5000 * F.col("l2.id")), answer("l2", F.lit(0.75)))
        .when(both & (F.col("l1.key") == F.col("word")), answer("l1", F.lit(1.0))).when(both, answer("l1", F.lit(0.75)))
        .when(far & (F.col("l2.id") > 5000 * F.col("l3.id")), answer("l3", base)).when(far, answer("l2", base)).otherwise(answer("top", base))
    )
    return a.withColumn("b", best).select("word", "b.value", gender_name(F.col("b.gender")).alias("gender"), (F.col("b.score") - (0.25 if lower else 0)).alias("score"))


def pick_double(c1: DataFrame, c2: DataFrame, pairs: DataFrame, k: int = 3) -> DataFrame:
    """Answers for pairs (w1, w2) of two readings of a name: the best candidate that both have, else the first's best at a quarter
    of its score, else the answer of the only reading that has candidates."""
    a = c1.select(F.col("word").alias("w1"), F.struct("n", "key", "gender", "score").alias("c"))
    b2 = c2.select(F.col("word").alias("w2"), F.col("key").alias("key2"))
    t1 = pick(c1, k).select(F.col("word").alias("w1"), F.struct("value", "gender", "score").alias("t1"))
    t2 = pick(c2, k).select(F.col("word").alias("w2"), F.struct("value", "gender", "score").alias("t2"))
    first = c1.groupBy(F.col("word").alias("w1")).agg(F.min_by(F.struct("key", "gender", "score"), "n").alias("i1"))
    p = pairs.select("w1", "w2").distinct()
    common = p.join(a, "w1").join(b2, "w2").where("c.key = key2").groupBy("w1", "w2").agg(F.min("c").alias("top"))
    j = p.join(common, ["w1", "w2"], "left").join(t1, "w1", "left").join(t2, "w2", "left").join(first, "w1", "left")
    other = (F.col("top.key") != F.col("w1")) & (F.col("top.key") != F.col("w2"))
    gender = lambda c: gender_name(F.col(f"{c}.gender"))
    whole = F.when((F.col("top.key") == F.col("w1")) | (F.col("top.key") == F.col("w2")), F.lit(1.0)).otherwise(F.col("top.score") / float(k + 1))
    best = (
        F.when(F.col("top").isNotNull() & other & (F.col("t1.score") == 1), F.col("t1")).when(F.col("top").isNotNull() & other & (F.col("t2.score") == 1), F.col("t2"))
        .when(F.col("top").isNotNull(), F.struct(F.col("top.key").alias("value"), gender("top").alias("gender"), whole.alias("score")))
        .when(F.col("t1").isNotNull() & F.col("t2").isNotNull(), F.struct(F.col("i1.key").alias("value"), gender("i1").alias("gender"), (F.col("i1.score") / 4.0).alias("score")))
        .otherwise(F.coalesce("t1", "t2"))
    )
    return j.withColumn("b", best).select("w1", "w2", "b.value", "b.gender", "b.score")


def pick_retry(queries: DataFrame, gazetteer: DataFrame, k: int = 3) -> DataFrame:
    """Answers for whole strings (column word); failing that for their first n, n - 1, ... 1 words, at a lowered score."""
    return with_retry(queries, lambda words: pick(candidates(words, gazetteer, k), k))


def pick_patronymic(queries: DataFrame, names: DataFrame, patronymics: DataFrame) -> DataFrame:
    """Answers for patronymics, with retries as for whole strings. The first word of a Turkic one is looked up as a given name,
    and its second word, which tells the gender, is put back."""
    k = MAX_DISTANCE["patronymic"]

    def answer(words: DataFrame) -> DataFrame:
        w = words.select("word").where("word is not null").distinct().withColumn("t", turkic_split(F.col("word")))
        turkic = F.coalesce(F.col("t.name") != "", F.lit(False))
        two = w.where(turkic).select("word", F.col("t.name").alias("given"), F.col("t.suffix").alias("suffix"))
        first = pick(candidates(two.select(F.col("given").alias("word")), names)).select(F.col("word").alias("g"), "value", "score")
        got = two.join(first, two.given == first.g).select("word", F.concat_ws(" ", "value", "suffix").alias("value"), F.when(F.col("suffix").isin(*TURKIC_MALE), "MALE").otherwise("FEMALE").alias("gender"), "score")
        return got.union(pick(candidates(w.where(~turkic).select("word"), patronymics, k), k))

    return with_retry(queries, answer)


def with_retry(queries: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """answer(words) gives (word, value, gender, score); it is asked for each whole string and for its first words, all at once,
    and the longest that has an answer counts, a shortened one at a score lower by 0.25."""
    q = queries.select("word").where("word is not null").distinct()
    n = F.size(F.split("word", " "))
    tries = F.when(n > 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("rank"), F.array_join(F.slice(F.split("word", " "), F.lit(1), n - i + 1), " ").alias("part")))).otherwise(F.array())
    t = q.select("word", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("rank"), F.col("word").alias("part"))), tries)).alias("t")).select("word", "t.rank", "t.part")
    got = answer(t.select(F.col("part").alias("word"))).withColumnRenamed("word", "part")
    best = t.join(got, "part").groupBy("word").agg(F.min_by(F.struct("value", "gender", "score", "rank"), "rank").alias("b"))
    return best.select("word", "b.value", "b.gender", (F.col("b.score") - F.when(F.col("b.rank") > 0, 0.25).otherwise(0)).alias("score"))


def suggest_licence(people: DataFrame, names: DataFrame, patronymics: DataFrame, surnames: DataFrame) -> DataFrame:
    """people (fam_rus, name_rus, others) with `suggest`: the first word of name_rus as a given name, the others as a patronymic,
    and fam_rus as a surname, each with value, gender and score (0 if there is none); null if none of them has an answer."""
    words = F.split(F.trim(F.regexp_replace("name_rus", r"\s+", " ")), " ")
    text = lambda c: F.when(c != "", c)
    asked = people.withColumn("__I", text(words[0])).withColumn("__O", F.when(F.size(words) > 1, F.array_join(F.slice(words, 2, F.size(words)), " "))).withColumn("__F", text(F.col("fam_rus")))
    of = lambda x: asked.select(F.col(f"__{x}").alias("word"))
    answers = {"F": pick_retry(of("F"), surnames), "I": pick_retry(of("I"), names), "O": pick_patronymic(of("O"), names, patronymics)}
    out = asked
    for x, got in answers.items():
        a = got.select(F.col("word").alias(f"__{x}_word"), F.struct("value", "gender", "score").alias(f"__{x}_answer"))
        out = out.join(a, F.col(f"__{x}") == F.col(f"__{x}_word"), "left")
    return out.withColumn("suggest", suggestion({x: F.col(f"__{x}_answer") for x in answers})).select(*[F.col(c) for c in people.columns], "suggest")


def suggestion(answers: dict[str, Column]) -> Column:
    """Answers, struct(value, gender, score), for each name as one struct with score 0 for a name without; null if there are none."""
    fields = [e for x, a in answers.items() for e in (a["value"].alias(x), a["gender"].alias(f"{x}_gender"), F.coalesce(a["score"], F.lit(0.0)).alias(f"{x}_score"))]
    return F.when(F.coalesce(*answers.values()).isNotNull(), F.struct(*fields))


def suggest_by_ways(pages: DataFrame, ways: dict[str, Column], names: DataFrame, patronymics: DataFrame, surnames: DataFrame) -> DataFrame:
    """pages with `suggest`. ways tells for each of F, I, O how it is looked up, struct(way, first, second): `double` asks for what both
    readings have in common, `retry` for one reading and its first words; null asks for nothing. Each distinct reading is
    looked up once, however many pages have it; pages keep their rows and columns."""
    on = pages.select("*", *[w.alias(f"__{x}") for x, w in ways.items()])
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.col(f"__{x}.way").alias("way"), F.col(f"__{x}.first").alias("first"), F.col(f"__{x}.second").alias("second")) for x in ways]))
    asked = stage(on.select(each.alias("a")).select("a.*").where("way is not null").distinct())
    known = {"F": surnames, "I": names, "O": patronymics}
    out = on
    for x, keys in known.items():
        mine = asked.where(F.col("x") == x)
        single = mine.where("way = 'retry'").select(F.col("first").alias("word"))
        got = pick_patronymic(single, names, keys) if x == "O" else pick_retry(single, keys, MAX_DISTANCE["name"])
        pairs = mine.where("way = 'double'").select(F.col("first").alias("w1"), F.col("second").alias("w2"))
        c = candidates(pairs.select(F.explode(F.array("w1", "w2")).alias("word")), keys, MAX_DISTANCE["patronymic" if x == "O" else "name"])
        both = pick_double(c, c, pairs, MAX_DISTANCE["patronymic" if x == "O" else "name"]).where("value is not null")
        a = got.select("word", F.lit(None).cast("string").alias("w2"), "value", "gender", "score").union(both.select("w1", "w2", "value", "gender", "score"))
        a = a.select(F.col("word").alias(f"__{x}_1"), F.col("w2").alias(f"__{x}_2"), F.struct("value", "gender", "score").alias(f"__{x}_answer"))
        out = out.join(a, (F.col(f"__{x}.first") == F.col(f"__{x}_1")) & F.col(f"__{x}.second").eqNullSafe(F.col(f"__{x}_2")), "left")
    return out.withColumn("suggest", suggestion({x: F.col(f"__{x}_answer") for x in known})).select(*[F.col(c) for c in pages.columns], "suggest")
