"""Whole-page fields over inputs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.operators import assembly, descriptors, gazetteer, pages, rules, votes
from paperloom.plans.base import spread, table
from paperloom.plans.pages import _view, in_gaz
from paperloom.sources import intake, recognize


def serial_halves(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.lpad(F.col("o_custkey").cast("string"), 10, "4").alias("s"))
    k = F.col("o_orderkey")
    one = o.select("o_orderkey", F.lit(0).alias("line"), F.when(k % 3 == 0, "").otherwise(F.col("s")).alias("left"), (k % 5).alias("left_raw"), F.when(k % 2 == 0, F.col("s")).otherwise(F.lpad("s", 9, "1")).alias("right"), (k % 4).alias("right_raw"))
    two = o.select("o_orderkey", F.lit(1), F.col("s"), F.lit(80), F.lit(""), F.lit(0))
    return pages.serial_number(one.union(two), ["o_orderkey"])


SERIAL = """WITH o AS (SELECT o_orderkey AS k, lpad(o_custkey::VARCHAR, 10, '4') AS s FROM orders)
SELECT k AS o_orderkey, s AS serial_number, k % 3 <> 0 AND k % 2 = 0 AS serial_number_check FROM o"""


def strip_cuts(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", pages.strip_cuts((F.col("p_size") * 31).cast("int"), (F.col("p_partkey") % 40 + 10).cast("int")).alias("c"))
    return p.select("p_partkey", F.size("c").alias("n"), F.element_at("c", -1)["end"].cast("int").alias("end"))


CUTS = "WITH p AS (SELECT p_partkey, p_size * 31 AS w, (p_partkey % 40 + 10)::INT AS h FROM part), n AS (SELECT *, greatest(floor(round_even(w / h, 0) / 4), 1)::INT AS n FROM p) SELECT p_partkey, n, least(n * 4 * h, w)::INT AS \"end\" FROM n"


def classify_page(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", votes.argmax(votes.mean_of([_view(i, 5) for i in range(4)])).alias("cls"), votes.rotation_vote([_view(i, 4) for i in range(4)]).alias("rot"), votes.argmax(F.slice(F.col("embedding").cast("array<double>"), 40, 2)).alias("main"))
    id_page = F.col("cls").isin(0, 4)
    sub = F.when(id_page & (F.col("main") == 0), "passport_main").otherwise("passport_other")
    return e.select("vec_id", rules.class_type(F.col("cls"), sub).alias("document_type"), F.when(id_page, F.col("rot")).alias("turns"))


CLASSIFY = """WITH e AS (SELECT vec_id, embedding, list_transform(range(1, 6), lambda i: ((embedding[i]::DOUBLE + embedding[i + 5]::DOUBLE) + embedding[i + 10]::DOUBLE) + embedding[i + 15]::DOUBLE) AS m,
  list_transform(range(0, 4), lambda i: ((embedding[i + 1]::DOUBLE + embedding[4 + (i + 3) % 4 + 1]::DOUBLE) + embedding[8 + (i + 2) % 4 + 1]::DOUBLE) + embedding[12 + (i + 1) % 4 + 1]::DOUBLE) AS r FROM embeddings),
c AS (SELECT vec_id, list_position(m, list_max(m)) - 1 AS cls, (list_position(r, list_max(r)) - 1)::INT AS rot, embedding[40] >= embedding[41] AS main FROM e)
SELECT vec_id, CASE cls WHEN 0 THEN CASE WHEN main THEN 100 ELSE 101 END WHEN 1 THEN 110 WHEN 2 THEN 120 WHEN 3 THEN 130 ELSE CASE WHEN main THEN 140 ELSE 130 END END AS document_type, CASE WHEN cls IN (0, 4) THEN rot END AS turns FROM c"""


def vote_categories(spark, sf):
    k = F.col("o_orderkey")
    t = F.concat(F.repeat(F.lit("B1 "), (k % 5).cast("int")), F.repeat(F.lit("C "), (k % 4).cast("int")), F.repeat(F.lit("8 "), (k % 3).cast("int")), F.repeat(F.lit("DE "), (k % 7).cast("int")))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(pages.vote_categories(t), ",").alias("c"))


CATEGORIES = """WITH o AS (SELECT o_orderkey AS k FROM orders), c AS (SELECT k, [CASE WHEN k % 4 > 0 AND k % 4 > k % 3 THEN 'C' WHEN k % 3 > 0 THEN 'B' WHEN k % 4 > 0 THEN 'C' END, CASE WHEN k % 5 > 2 THEN 'B1' END, CASE WHEN k % 7 > 2 THEN 'DE' END] AS c FROM o)
SELECT k AS o_orderkey, array_to_string(list_sort(list_filter(c, lambda x: x IS NOT NULL)), ',') AS c FROM c"""


def line_angles(spark, sf):
    e = table(spark, sf, "embeddings")
    v = lambda i: F.get(F.col("embedding").cast("array<double>"), F.lit(i))
    return e.select("vec_id", F.round(pages.line_degrees(v(0), v(1), v(2), v(3)), 6).alias("a"))


ANGLES = "WITH e AS (SELECT vec_id, degrees(atan2(embedding[4]::DOUBLE - embedding[2]::DOUBLE, embedding[3]::DOUBLE - embedding[1]::DOUBLE)) AS a FROM embeddings) SELECT vec_id, round(CASE WHEN a > 90 THEN a - 180 WHEN a < -90 THEN a + 180 ELSE a END, 6) AS a FROM e"


def descriptor_match(spark, sf):
    """Points from the signs of vectors, twenty to a page; each page is matched with the first page of its five. Nearest ones that are clearly nearer."""
    half = lambda at: F.lpad(F.hex(F.aggregate(F.slice("embedding", at, 32), F.lit(0).cast("long"), lambda a, x: a * 2 + (x > 0).cast("int"))), 8, "0")
    e = table(spark, sf, "embeddings").select((F.col("vec_id") / 20).cast("long").alias("page_id"), (F.col("vec_id") % 20).cast("int").alias("kp"), F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y"), F.unhex(F.concat(half(1), half(33))).alias("desc"))
    first = e.where("page_id % 5 = 0").withColumn("template", (F.col("page_id") / 5).cast("long"))
    pairs = e.select("page_id", (F.col("page_id") / 5).cast("long").alias("template")).distinct()
    got = descriptors.match(e, first.drop("page_id"), pairs, ratio=0.9, filtered=False)
    return got.select("page_id", "template", F.explode("matches").alias("m")).select("page_id", "template", "m.page_kp", "m.template_kp", "m.distance")


DESCRIPTORS = """
WITH e AS (SELECT vec_id // 20 AS page_id, (vec_id % 20)::INT AS kp, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings),
d AS (
  SELECT p.page_id, p.page_id // 5 AS template, p.kp AS page_kp, t.kp AS template_kp, list_sum(list_transform(range(1, 65), lambda k: (p.b[k] <> t.b[k])::INT))::INT AS distance
  FROM e p JOIN e t ON t.page_id % 5 = 0 AND t.page_id // 5 = p.page_id // 5
), n AS (SELECT *, row_number() OVER w AS r, lead(distance) OVER w AS second FROM d WINDOW w AS (PARTITION BY page_id, page_kp ORDER BY distance, template_kp))
SELECT page_id, template, page_kp, template_kp, distance FROM n WHERE r = 1 AND distance < 0.9 * second
"""


def gazetteer_load(spark, sf):
    """Words of parts' names as lines of a gazetteer, most of them repeated, with one gender or another."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.explode(F.split("p_name", " ")).alias("word"))
    return gazetteer.load(p.groupBy("id", "word").agg(F.max(F.element_at(F.array(F.lit("MALE"), F.lit("FEMALE"), F.lit("OTHER")), (F.col("id") % 3 + 1).cast("int"))).alias("gender")))


GAZETTEER_LOAD = """WITH w AS (SELECT DISTINCT p_partkey AS id, unnest(string_split(p_name, ' ')) AS word FROM part)
SELECT word AS key, min(id) AS id, CASE max(id) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END::INT AS gender FROM w GROUP BY word"""


def intake_requests(spark, sf):
    """A request for each order: routes, HTTP methods, priorities, none, one or two files, names of all kinds."""
    k = F.col("o_orderkey")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    file = F.struct(pick(("scan.pdf", "a.JPEG", "b.txt", "", "photo.png"), k).alias("name"), F.lit(b"x").alias("content"))
    files = F.when(k % 11 == 0, F.array(file, file)).when(k % 13 == 0, F.slice(F.array(file), 1, 0)).otherwise(F.array(file))
    r = table(spark, sf, "orders").select(k.alias("request_id"), pick([*intake.ROUTES, "/else"], k).alias("path"), pick(("POST", "POST", "POST", "GET"), k).alias("http_method"), pick(("0", "1", "", "x"), F.floor(k / 4)).alias("priority"), files.alias("files"))
    return intake.answer(r).select("request_id", "method", "code", "high", F.get_json_object("body", "$.description").alias("message"), F.substr("file_name", F.lit(33)).alias("ending"))


INTAKE = f"""WITH o AS (SELECT o_orderkey AS k, {list(intake.ROUTES.values())}[o_orderkey % 7 + 1] AS method, ['scan.pdf', 'a.JPEG', 'b.txt', '', 'photo.png'][o_orderkey % 5 + 1] AS name FROM orders),
c AS (
  SELECT *, CASE WHEN method IS NULL THEN 404 WHEN k % 4 = 3 THEN 200 WHEN k // 4 % 4 = 3 OR (k % 13 = 0 AND k % 11 <> 0) THEN 500 WHEN k % 11 = 0 OR name IN ('', 'b.txt') THEN 400 ELSE 200 END::INT AS code FROM o
) SELECT k AS request_id, method, code, CASE WHEN code = 200 AND k % 4 < 3 THEN k // 4 % 4 = 1 END AS high,
  CASE WHEN code = 400 THEN CASE WHEN k % 11 = 0 THEN '{intake.TOO_MANY}' WHEN name = '' THEN '{intake.NO_FILE}' ELSE '{intake.WRONG_KIND}' END END AS message,
  CASE WHEN code = 200 AND k % 4 < 3 THEN '.' || right(name, 4) END AS ending FROM c"""


def progress_merge(spark, sf):
    known = F.when(F.col("event_type").isin("click", "purchase"), (F.col("event_id") % 7).cast("int"))
    e = table(spark, sf, "events").select(F.col("user_id").alias("job_id"), (F.col("event_id") % 3).cast("int").alias("page"), "event_id", known.alias("document_type"), (F.col("event_id") % 101).cast("int").alias("page_progress"), F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 4 == 0), (F.col("event_id") % 5).cast("int")).alias("qc"))
    return pages.merge_progress(e, "job_id", "page", "event_id")


MERGE = """
WITH u AS (
  SELECT user_id AS job_id, (event_id % 3)::INT AS page, event_id, CASE WHEN event_type IN ('click', 'purchase') THEN (event_id % 7)::INT END AS t, (event_id % 101)::INT AS p,
    CASE WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN (event_id % 5)::INT END AS qc FROM events
), d AS (SELECT *, max(event_id) FILTER (qc IS NOT NULL) OVER (PARTITION BY job_id, page) AS done, min(event_id) OVER (PARTITION BY job_id, page) AS first FROM u)
SELECT job_id, page, max(CASE WHEN event_id = coalesce(done, first) THEN CASE WHEN done IS NULL THEN nullif(t, 0) ELSE t END END) AS document_type,
  arg_max(p, event_id) FILTER (done IS NULL OR event_id > done) AS page_progress, coalesce(max(qc) FILTER (event_id = done), -1) AS qc
FROM d GROUP BY job_id, page
"""


def handwriting_gate(spark, sf):
    """Each text as a rectangle whose lines are its pieces."""
    d = table(spark, sf, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda x: x.cast("binary")).alias("pieces"))
    got = recognize.written(d, "doc_id", recognize.FixtureRecognizer)
    return got.select("doc_id", F.size("answers").alias("n"), F.size(F.filter("answers", lambda x: x)).alias("n_written"), F.exists("answers", lambda x: x).alias("some"))


GATE = r"""WITH d AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_matches(x, '[0-9]')) AS a FROM documents)
SELECT doc_id, coalesce(len(a), -1)::INT AS n, coalesce(len(list_filter(a, lambda x: x)), -1)::INT AS n_written, list_contains(a, true) AS some FROM d"""


def licence_suggest(spark, sf):
    """Suggestions for licence holders from misread names: words of parts' names as given names, whole ones as patronymics and
    surnames; some names have one word, some words too many, some are empty."""
    p = table(spark, sf, "part").select("p_name").distinct()
    n, one = F.length("p_name"), F.split("p_name", " ")[0]
    people = p.select(
        "p_name",
        F.when(n % 5 != 0, F.concat("p_name", F.when(n % 2 == 0, "x").otherwise(" qqqqqq zz"))).otherwise("").alias("fam_rus"),
        F.when(n % 4 == 0, one).when(n % 4 == 1, F.concat(one, F.lit("z "), "p_name", F.lit("xyzw"))).when(n % 4 == 2, F.concat(one, F.lit(" "), "p_name", F.lit(" qqqqqq"))).alias("name_rus"),
    )
    g = in_gaz(spark, sf)
    first = p.select(one.alias("key")).distinct()
    names = first.select("key", F.row_number().over(W.orderBy("key")).alias("id"), (F.length("key") % 3).alias("gender"))
    got = gazetteer.suggest_licence(people, names, g, g)
    return got.select("p_name", "fam_rus", "name_rus", F.col("suggest").isNotNull().alias("found"), "suggest.*")


def _answers(x: str, asked: str, keys: str, k: int) -> str:
    """SQL for the answers {x} (word, value, score) of the strings in `asked`, with retries, from the table `keys` (key, id)."""
    return f""",
{x}0 AS (SELECT DISTINCT {asked} AS word FROM h WHERE {asked} IS NOT NULL), {x}1 AS (SELECT word, string_split(word, ' ') AS s FROM {x}0),
{x}2 AS (SELECT word, s, unnest(range(0, CASE WHEN len(s) > 1 THEN len(s) + 1 ELSE 1 END)) AS rank FROM {x}1),
{x}3 AS (SELECT word, rank, CASE WHEN rank = 0 THEN word ELSE array_to_string(s[1:len(s) - rank + 1], ' ') END AS part FROM {x}2),
{x}4 AS (SELECT DISTINCT part, id, key, levenshtein(part, key) AS d FROM {x}3, {keys} WHERE levenshtein(part, key) <= {k}),
{x}5 AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY d, id) AS n FROM {x}4),
{x}6 AS (SELECT part, arg_min(key, n) AS top, min(d) AS d, min({{'id': id, 'key': key}}) FILTER (d = 0) AS l1, min({{'id': id, 'key': key}}) FILTER (d = 1) AS l2, min({{'id': id, 'key': key}}) FILTER (d = 2) AS l3 FROM {x}5 WHERE n <= 5 GROUP BY part),
{x}7 AS (SELECT part, CASE WHEN l1 IS NOT NULL AND l2 IS NOT NULL THEN CASE WHEN l1.id > 5000 * l2.id THEN l2.key ELSE l1.key END
  WHEN l2 IS NOT NULL AND l3 IS NOT NULL THEN CASE WHEN l2.id > 5000 * l3.id THEN l3.key ELSE l2.key END ELSE top END AS value,
  CASE WHEN l1 IS NOT NULL AND l2 IS NOT NULL THEN CASE WHEN l1.id > 5000 * l2.id THEN 0.75 WHEN l1.key = part THEN 1 ELSE 0.75 END ELSE ({k} + 1 - d) / ({k} + 1) END::DOUBLE AS score FROM {x}6),
{x}8 AS (SELECT word, arg_min({{'value': value, 'score': score, 'rank': rank}}, rank) AS b FROM {x}3 JOIN {x}7 USING (part) GROUP BY word),
{x} AS (SELECT word, b.value AS value, b.score - CASE WHEN b.rank > 0 THEN 0.25 ELSE 0 END AS score, ['UNKNOWN', 'MALE', 'FEMALE'][length(b.value) % 3 + 1] AS gender FROM {x}8)"""


SUGGEST = (
    """WITH n AS (SELECT p_name AS key, count(*) AS c FROM part GROUP BY 1), g AS (SELECT key, row_number() OVER (ORDER BY c DESC, key) AS id FROM n),
f AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS key FROM part), fg AS (SELECT key, row_number() OVER (ORDER BY key) AS id FROM f),
b AS (SELECT DISTINCT p_name, length(p_name) AS n, string_split(p_name, ' ')[1] AS one FROM part),
h AS (SELECT p_name, CASE WHEN n % 5 = 0 THEN '' WHEN n % 2 = 0 THEN p_name || 'x' ELSE p_name || ' qqqqqq zz' END AS fam_rus,
  CASE n % 4 WHEN 0 THEN one WHEN 1 THEN one || 'z ' || p_name || 'xyzw' WHEN 2 THEN one || ' ' || p_name || ' qqqqqq' END AS name_rus,
  CASE WHEN n % 5 <> 0 THEN CASE WHEN n % 2 = 0 THEN p_name || 'x' ELSE p_name || ' qqqqqq zz' END END AS af, CASE n % 4 WHEN 0 THEN one WHEN 1 THEN one || 'z' WHEN 2 THEN one END AS ai,
  CASE n % 4 WHEN 1 THEN p_name || 'xyzw' WHEN 2 THEN p_name || ' qqqqqq' END AS ao FROM b)"""
    + _answers("sf", "af", "g", 3) + _answers("si", "ai", "fg", 3) + _answers("so", "ao", "g", 4)
    + """ SELECT p_name, fam_rus, name_rus, sf.word IS NOT NULL OR si.word IS NOT NULL OR so.word IS NOT NULL AS found,
  sf.value AS F, sf.gender AS F_gender, CASE WHEN found THEN coalesce(sf.score, 0) END AS F_score, si.value AS I, si.gender AS I_gender, CASE WHEN found THEN coalesce(si.score, 0) END AS I_score,
  so.value AS O, so.gender AS O_gender, CASE WHEN found THEN coalesce(so.score, 0) END AS O_score FROM h LEFT JOIN sf ON af = sf.word LEFT JOIN si ON ai = si.word LEFT JOIN so ON ao = so.word"""
)


def passport_suggest(spark, sf):
    """Suggestions for passport pages whose zone and printed lines are misread in ways of their own, or not read at all."""
    p = table(spark, sf, "part").select("p_name").distinct()
    n, one = F.length("p_name"), F.split("p_name", " ")[0]
    zone = F.struct(
        F.when(n % 3 != 0, F.concat(F.substr("p_name", F.lit(1), F.lit(2)), F.substr("p_name", F.lit(4)))).alias("f"), F.when(n % 2 == 0, one).otherwise("").alias("i"), F.when(n % 5 < 2, F.concat("p_name", F.lit(" qqqqqq"))).alias("o"),
    )
    bottom = F.struct(F.when(n % 4 != 0, F.concat("p_name", F.lit("z"))).alias("F"), F.when(n % 3 != 1, F.concat(one, F.lit("z"))).alias("I"), F.when(n % 5 < 4, F.concat("p_name", F.lit("xyzw"))).alias("O"))
    p = p.select("p_name", F.when(n % 7 != 0, zone).alias("zone"), F.when(n % 11 != 0, bottom).alias("bottom"))
    names = p.select(one.alias("key")).distinct()
    names = names.select("key", F.row_number().over(W.orderBy("key")).alias("id"), (F.length("key") % 3).alias("gender"))
    g = in_gaz(spark, sf)
    got = gazetteer.suggest_by_ways(p, assembly.suggestion_ways(F.col("zone"), F.col("bottom")), names, g, g)
    return got.select("p_name", F.col("suggest").isNotNull().alias("found"), "suggest.*")


def _both(x: str, z: str, b: str, keys: str) -> str:
    """SQL for the answers {x} (w1, w2, value, score, gender) of pairs of readings {z} and {b} in h, from the table `keys` (key, id)."""
    at = lambda d: f"min({{'id': id, 'key': key}}) FILTER (d = {d})"
    return f""",
{x}0 AS (SELECT DISTINCT {z} AS w1, {b} AS w2 FROM h WHERE {z} IS NOT NULL AND {b} IS NOT NULL), {x}1 AS (SELECT w1 AS word FROM {x}0 UNION SELECT w2 FROM {x}0),
{x}2 AS (SELECT word, id, key, levenshtein(word, key) AS d FROM {x}1, {keys} WHERE levenshtein(word, key) <= 3),
{x}3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY d, id) AS n FROM {x}2) WHERE n <= 5),
{x}4 AS (SELECT word, arg_min(key, n) AS top, min(d) AS d, {at(0)} AS l1, {at(1)} AS l2, {at(2)} AS l3 FROM {x}3 GROUP BY word),
{x}5 AS (SELECT word, top, d, CASE WHEN l1 IS NOT NULL AND l2 IS NOT NULL THEN CASE WHEN l1.id > 5000 * l2.id THEN l2.key ELSE l1.key END
  WHEN l2 IS NOT NULL AND l3 IS NOT NULL THEN CASE WHEN l2.id > 5000 * l3.id THEN l3.key ELSE l2.key END ELSE top END AS value,
  CASE WHEN l1 IS NOT NULL AND l2 IS NOT NULL THEN CASE WHEN l1.key = word AND l1.id <= 5000 * l2.id THEN 1 ELSE 0.75 END ELSE (4 - d) / 4 END::DOUBLE AS score FROM {x}4),
{x}6 AS (SELECT w1, w2, min({{'n': a.n, 'key': a.key, 'd': a.d}}) AS top FROM {x}0 JOIN {x}3 a ON a.word = w1 JOIN {x}3 b ON b.word = w2 AND a.key = b.key GROUP BY 1, 2),
{x}7 AS (SELECT q.w1, q.w2, m.top, m.top.key IN (q.w1, q.w2) AS exact, a.value AS v1, a.score AS s1, a.top AS t1, a.d AS d1, b.value AS v2, b.score AS s2
  FROM {x}0 q LEFT JOIN {x}6 m ON m.w1 = q.w1 AND m.w2 = q.w2 LEFT JOIN {x}5 a ON a.word = q.w1 LEFT JOIN {x}5 b ON b.word = q.w2),
{x}8 AS (SELECT w1, w2, CASE WHEN top IS NULL THEN CASE WHEN v1 IS NOT NULL AND v2 IS NOT NULL THEN t1 ELSE coalesce(v1, v2) END WHEN NOT exact AND s1 = 1 THEN v1 WHEN NOT exact AND s2 = 1 THEN v2 ELSE top.key END AS value,
  CASE WHEN top IS NULL THEN CASE WHEN v1 IS NOT NULL AND v2 IS NOT NULL THEN (4 - d1) / 4 ELSE coalesce(s1, s2) END WHEN exact OR s1 = 1 OR s2 = 1 THEN 1 ELSE (4 - top.d) / 4 END::DOUBLE AS score FROM {x}7),
{x} AS (SELECT *, ['UNKNOWN', 'MALE', 'FEMALE'][length(value) % 3 + 1] AS gender FROM {x}8 WHERE value IS NOT NULL)"""


PASSPORT_SUGGEST = (
    """WITH n AS (SELECT p_name AS key, count(*) AS c FROM part GROUP BY 1), g AS (SELECT key, row_number() OVER (ORDER BY c DESC, key) AS id FROM n),
f AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS key FROM part), fg AS (SELECT key, row_number() OVER (ORDER BY key) AS id FROM f),
b AS (SELECT DISTINCT p_name, length(p_name) AS n, string_split(p_name, ' ')[1] AS one FROM part),
r AS (SELECT p_name, CASE WHEN n % 7 <> 0 AND n % 3 <> 0 THEN substr(p_name, 1, 2) || substr(p_name, 4) END AS zf, CASE WHEN n % 7 <> 0 AND n % 2 = 0 THEN one END AS zi, CASE WHEN n % 7 <> 0 AND n % 5 < 2 THEN p_name || ' qqqqqq' END AS zo,
  CASE WHEN n % 11 <> 0 AND n % 4 <> 0 THEN p_name || 'z' END AS bf, CASE WHEN n % 11 <> 0 AND n % 3 <> 1 THEN one || 'z' END AS bi, CASE WHEN n % 11 <> 0 AND n % 5 < 4 THEN p_name || 'xyzw' END AS bo FROM b),
h AS (SELECT *, CASE WHEN zf IS NULL OR bf IS NULL THEN coalesce(zf, bf) END AS af, CASE WHEN zi IS NULL OR bi IS NULL THEN coalesce(zi, bi) END AS ai, coalesce(zo, bo) AS ao FROM r)"""
    + _answers("sf", "af", "g", 3) + _answers("si", "ai", "fg", 3) + _answers("so", "ao", "g", 4) + _both("df", "zf", "bf", "g") + _both("di", "zi", "bi", "fg")
    + """ SELECT p_name, sf.word IS NOT NULL OR si.word IS NOT NULL OR so.word IS NOT NULL OR df.w1 IS NOT NULL OR di.w1 IS NOT NULL AS found,
  coalesce(df.value, sf.value) AS F, coalesce(df.gender, sf.gender) AS F_gender, CASE WHEN found THEN coalesce(df.score, sf.score, 0) END AS F_score,
  coalesce(di.value, si.value) AS I, coalesce(di.gender, si.gender) AS I_gender, CASE WHEN found THEN coalesce(di.score, si.score, 0) END AS I_score,
  so.value AS O, so.gender AS O_gender, CASE WHEN found THEN coalesce(so.score, 0) END AS O_score
  FROM h LEFT JOIN sf ON af = sf.word LEFT JOIN si ON ai = si.word LEFT JOIN so ON ao = so.word LEFT JOIN df ON zf = df.w1 AND bf = df.w2 LEFT JOIN di ON zi = di.w1 AND bi = di.w2"""
)


def licence_front(spark, sf):
    """A licence front for each customer, with the same words in both languages' readings."""
    c = spread(table(spark, sf, "customer").select("c_custkey"))
    k = F.col("c_custkey").cast("string")
    word = lambda x, y, t: F.struct(F.lit(x).alias("left"), F.lit(y).alias("top"), F.concat(t, F.lit("")).alias("text"))
    rows = F.array(word(60, 30, F.lit("ПЕТРОВ")), word(60, 55, F.lit("PETROV")), word(60, 88, F.lit("ИВАН")), word(60, 114, F.lit("IVAN")), word(60, 145, F.lit("01.02.1980")), word(60, 174, F.lit("ОМСК")), word(60, 204, F.lit("OMSK")), word(60, 239, F.lit("09.10.2018")), word(314, 239, F.lit("09.10.2028")), word(60, 272, F.lit("ГИБДД")), word(60, 297, F.lit("GIBDD")), word(60, 335, F.lpad(k, 10, "5")))
    w = c.select("c_custkey", F.posexplode(rows).alias("idx", "w")).select("c_custkey", "idx", "w.*")
    return pages.licence_front(w.withColumn("lang", F.explode(F.array(F.lit("rus"), F.lit("eng")))), ["c_custkey"])


FRONT = "SELECT c_custkey, 'ПЕТРОВ' AS fam_rus, 'PETROV' AS fam_eng, 'ИВАН' AS name_rus, 'IVAN' AS name_eng, 'ОМСК' AS birthplace3_rus, 'OMSK' AS birthplace3_eng, 'ГИБДД' AS p4c_rus, 'GIBDD' AS p4c_eng, NULL::VARCHAR AS p8_rus, NULL::VARCHAR AS p8_eng, true AS fam_check, true AS name_check, true AS birthplace3_check, true AS p4c_check, false AS p8_check, '01.02.1980' AS p3, '09.10.2018' AS p4a, '09.10.2028' AS p4b, lpad(c_custkey::VARCHAR, 10, '5') AS p5, true AS p4ab_check FROM customer"


def top_page(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    tokens = [(0, "ПАСПОРТ"), (1, "ОТДЕЛОМ"), (1, "12"), (1, "УВД"), (2, "ОМСКА"), (3, "УФМС"), (3, "05.03.2019"), (3, "770-012"), (4, "ПОЗЖЕ")]
    rows = F.array(*[F.struct(F.lit(n).alias("line"), F.lit(i).alias("idx"), F.lit(t).alias("text")) for i, (n, t) in enumerate(tokens)])
    w = c.select("c_custkey", F.explode(rows).alias("w")).select("c_custkey", "w.*").where("line != 3 or c_custkey % 2 = 0")
    return pages.top_page(w, ["c_custkey"])


TOP = "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'ОТДЕЛОМ УВД ОМСКА УФМС' ELSE 'ОТДЕЛОМ УВД ОМСКА ПОЗЖЕ' END AS vidan, CASE WHEN c_custkey % 2 = 0 THEN '05.03.2019' END AS data_vid, CASE WHEN c_custkey % 2 = 0 THEN '770-012' END AS code_pod FROM customer"


def bottom_text(spark, sf):
    """Lower pages read box by box: labels, lines that may be missing, a gender or a date alone, and words after it."""
    c = table(spark, sf, "customer").select("c_custkey")
    k = F.col("c_custkey")
    boxes = [
        (0, F.lit("Петров")), (1, F.lit("ИМЯ")), (1, F.when(k % 3 != 0, "ИВАН").otherwise("ИВ")), (2, F.lit("ОТЧЕСТВО")), (2, F.lit("ИЛЬИЧ")),
        (3, F.when(k % 2 == 0, "МУЖ").otherwise("12")), (3, F.concat(F.lit("0"), (k % 9 + 1).cast("string"), F.lit(".05.1980"))), (4, F.lit("ГОР ОМСК")), (4, F.lit("жен")),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("line"), F.lit(i).alias("idx"), F.concat(t, F.lit("")).alias("text")) for i, (n, t) in enumerate(boxes)])
    w = c.select("c_custkey", F.explode(rows).alias("w")).select("c_custkey", "w.*").where("line != c_custkey % 7")
    return pages.bottom_text(w, ["c_custkey"])


# Without line 0 the labels' line is the surname; without line 3 nothing ends the names, and the first short word of the next
# line hides the gender behind it.
BOTTOM_TEXT = """WITH c AS (SELECT c_custkey AS k, c_custkey % 7 AS x, c_custkey % 3 <> 0 AS four FROM customer)
SELECT k AS c_custkey, CASE WHEN x <> 0 THEN 'ПЕТРОВ' WHEN four THEN 'ИМЯ ИВАН' ELSE 'ИМЯ ИВ' END AS F, CASE WHEN x < 2 THEN 'ИЛЬИЧ' WHEN four THEN 'ИВАН' WHEN x > 2 THEN 'ИЛЬИЧ' END AS I,
  CASE WHEN x > 2 AND four THEN 'ИЛЬИЧ' WHEN x = 3 THEN 'ГОР' END AS O, CASE WHEN x <> 3 AND k % 2 = 0 THEN 'МУЖ' END AS gender,
  CASE WHEN x <> 3 AND k % 2 = 1 THEN '0' || (k % 9 + 1) || '.05.1980' END AS birth_date, CASE WHEN x NOT IN (3, 4) THEN 'ГОР ОМСК' END AS birth_place FROM c"""

QUERIES = {
    "serial_halves": (serial_halves, SERIAL),
    "strip_cuts": (strip_cuts, CUTS),
    "classify_page": (classify_page, CLASSIFY),
    "vote_categories": (vote_categories, CATEGORIES),
    "line_angles": (line_angles, ANGLES),
    "progress_merge": (progress_merge, MERGE),
    "gazetteer_load": (gazetteer_load, GAZETTEER_LOAD),
    "intake_requests": (intake_requests, INTAKE),
    "descriptor_match": (descriptor_match, DESCRIPTORS),
    "handwriting_gate": (handwriting_gate, GATE),
    "licence_suggest": (licence_suggest, SUGGEST),
    "passport_suggest": (passport_suggest, PASSPORT_SUGGEST),
    "licence_front": (licence_front, FRONT),
    "top_page": (top_page, TOP),
    "bottom_text": (bottom_text, BOTTOM_TEXT),
}
