"""Page types, jobs, names, votes, layout, fusion and streams, over inputs derived from the driver's tables."""

from __future__ import annotations

import os
import tempfile

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.operators import fuse, gazetteer, jobs, layout, rules, votes
from paperloom.plans import pdf_inputs
from paperloom.plans.base import spread, table, words
from paperloom.sources import files, pdf, pixels, recognize, store
from paperloom.streaming import jobs as stream
from paperloom.streaming import progress as state

# --- scans and filters ---


def scan_documents(spark, sf):
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def filter_ext(spark, sf):
    ext = F.element_at(F.array(*map(F.lit, (".pdf", ".PNG", ".txt", ".jpe", "", ".jpeg"))), (F.col("page_id") % 6 + 1).cast("int"))
    p = table(spark, sf, "pages").select("page_id", F.concat(F.lit("in/scan.v2_"), F.col("page_id").cast("string"), ext).alias("path"))
    return p.where(files.supported_file(F.col("path")))


FILTER_EXT = "SELECT page_id, 'in/scan.v2_' || page_id || ['.pdf', '.PNG', '.txt', '.jpe', '', '.jpeg'][(page_id % 6 + 1)::INT] AS path FROM pages WHERE page_id % 6 IN (0, 1, 3, 5)"


def strip_html_pages(spark, sf):
    t = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "[ \n\t]+", " "))
    return table(spark, sf, "pages").select("page_id", t.alias("text"))


# --- page types ---
PAGE_TYPES = [40, 140, 100, 130, 11, 12, 80, 56, 46, 130, 140, 20, 0, 101]


def in_pages(spark, sf) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, PAGE_TYPES)), ((F.col("conv_id") * 7 + F.col("turn") * 3) % len(PAGE_TYPES) + 1).cast("int"))
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("page_num"), F.when(F.col("turn") % 6 != 5, kind).alias("document_type"), ((F.col("conv_id") + F.col("turn")) % 5).cast("int").alias("qc"), F.lit("page").alias("description"))


PAGES = f"WITH p AS (SELECT conv_id AS job_id, turn AS page_num, CASE WHEN turn % 6 <> 5 THEN {PAGE_TYPES}[((conv_id * 7 + turn * 3) % {len(PAGE_TYPES)} + 1)::INT] END AS document_type, ((conv_id + turn) % 5)::INT AS qc, 'page' AS description FROM conversations) "


def class_restrict(spark, sf):
    k = F.col("document_type")
    return in_pages(spark, sf).select("job_id", "page_num", rules.restrict(k, [100]).cast("int").alias("a"), rules.restrict(k, [130]).cast("int").alias("b"), rules.restrict(k, [100, 130, 140]).cast("int").alias("c"), rules.restrict(k, None).alias("d"))


CLASS_RESTRICT = PAGES + """SELECT job_id, page_num, CASE WHEN document_type IN (100, 140) THEN 100 ELSE 0 END AS a, CASE WHEN document_type IN (130, 140) THEN 130 ELSE 0 END AS b,
  CASE WHEN document_type IN (100, 130, 140) THEN document_type ELSE 0 END AS c, document_type AS d FROM p"""


def class_to_type(spark, sf):
    sub = F.when(F.col("turn") % 2 == 0, "passport_main").otherwise("passport_other")
    return table(spark, sf, "conversations").select("conv_id", "turn", rules.class_type(F.col("conv_id") % 5, sub).alias("t"))


CLASS_TYPE = "SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN CASE WHEN turn % 2 = 0 THEN 100 ELSE 101 END WHEN 1 THEN 110 WHEN 2 THEN 120 WHEN 3 THEN 130 ELSE CASE WHEN turn % 2 = 0 THEN 140 ELSE 130 END END AS t FROM conversations"


def parser_dispatch(spark, sf):
    return in_pages(spark, sf).groupBy(rules.parser_of(F.col("document_type")).alias("parser")).agg(F.count("*").alias("n"))


PARSER = PAGES + """SELECT CASE WHEN document_type = 0 THEN 'unknown' WHEN document_type = 100 THEN 'passport' WHEN document_type = 130 THEN 'licence' WHEN document_type = 140 THEN 'combined'
  WHEN document_type IN (101, 120) THEN 'skip' WHEN document_type IN (10, 40, 41, 42, 43, 45, 46) THEN 'handwriting' ELSE 'common' END AS parser, count(*) AS n FROM p GROUP BY 1"""
TOKENS = sorted({w for r in rules.RULES for part in r[:3] for w in part if len(w) > 1})


def in_text(spark, sf) -> DataFrame:
    """Texts of four rule words each, in mixed case and with noise."""
    pick = lambda a, b: F.element_at(F.array(*map(F.lit, TOKENS)), ((F.col("o_orderkey") * a + b) % len(TOKENS) + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", F.concat(pick(1, 0), F.lit(" 12, "), F.lower(pick(7, 3)), F.lit("-x\n"), pick(13, 5), pick(1, 1)).alias("t"))


_PICK = lambda a, b: f"{words(TOKENS)}[((o_orderkey * {a} + {b}) % {len(TOKENS)} + 1)::INT]"
TEXT = f"t AS (SELECT o_orderkey, upper(regexp_replace({_PICK(1, 0)} || ' 12, ' || lower({_PICK(7, 3)}) || '-x' || chr(10) || {_PICK(13, 5)} || {_PICK(1, 1)}, '[^А-Яа-я№]', '', 'g')) AS t FROM orders)"
_RULES = ", ".join(f"({i}, {words(r[0])}::VARCHAR[], {words(r[1])}::VARCHAR[], {words(r[2])}::VARCHAR[], {r[3]}, '{r[4]}')" for i, r in enumerate(rules.by_priority()))
RULES = f"r(prio, must, several, never, id, description) AS (VALUES {_RULES}), " + TEXT + """, m AS (SELECT o_orderkey, id, description, prio FROM t JOIN r
  ON len(list_filter(must, lambda x: NOT contains(t, x))) = 0 AND len(list_filter(never, lambda x: contains(t, x))) = 0
  AND len(list_filter(several, lambda x: contains(t, x))) >= round_even(len(several) / 2, 0))"""


def rule_classify(spark, sf):
    t = in_text(spark, sf).select("o_orderkey", rules.normalise(F.col("t")).alias("n"))
    return t.select("o_orderkey", rules.classify(F.col("n")).alias("c")).select("o_orderkey", "c.document_type", "c.description")


def rule_hit_counts(spark, sf):
    t = in_text(spark, sf).select("o_orderkey", rules.normalise(F.col("t")).alias("n"))
    hit = F.array_compact(F.array(*[F.when(rules.hits(F.col("n"), r), F.lit(r[3])) for r in rules.RULES]))
    return t.select(F.explode(hit).alias("id")).groupBy("id").agg(F.count("*").alias("n"))


def rule_classify_rotations(spark, sf):
    """Two turns of an order each: the first is empty for one in three."""
    t = in_text(spark, sf)
    ocr = t.select("o_orderkey", F.lit(0).alias("turn"), F.when(F.col("o_orderkey") % 3 != 0, F.col("t")).otherwise("123").alias("text")).union(t.select("o_orderkey", F.lit(1), "t"))
    return rules.classify_turns(ocr, ["o_orderkey"])


ROTATIONS = "WITH " + RULES + " SELECT o_orderkey, arg_min(id, prio)::BIGINT AS document_type, arg_min(description, prio) AS description, CASE WHEN o_orderkey % 3 <> 0 THEN 0 ELSE 1 END AS turns FROM m GROUP BY o_orderkey"

# --- jobs ---


def continuation_mark(spark, sf):
    return jobs.mark_continuation(in_pages(spark, sf))


CONTINUATION = PAGES + f""", c AS (SELECT unnest({list(rules.CONTINUED)}) AS id, unnest({list(rules.CONTINUED.values())}) AS most),
b AS (SELECT *, coalesce(document_type IN (100, 130, 140) AND qc IN (3, 4), false) AS bad FROM p),
g AS (SELECT *, sum(CASE WHEN document_type IS NOT NULL AND NOT bad THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY page_num) AS grp FROM b),
k AS (SELECT *, max(CASE WHEN NOT bad THEN document_type END) OVER (PARTITION BY job_id, grp) AS dt0, sum(bad::INT) OVER (PARTITION BY job_id, grp ORDER BY page_num) AS k FROM g),
f AS (SELECT k.*, bad AND grp > 0 AND most IS NOT NULL AND (most = 0 OR k < most) AS cont FROM k LEFT JOIN c ON c.id = dt0)
SELECT job_id, page_num, CASE WHEN cont THEN dt0 ELSE document_type END AS document_type, CASE WHEN cont THEN 0 ELSE qc END AS qc, CASE WHEN cont THEN 'second page' ELSE description END AS description FROM f"""


def first_orientation(spark, sf):
    p = in_pages(spark, sf).withColumn("orientation", F.when(F.col("qc") > 2, (F.col("page_num") % 4).cast("int")))
    return jobs.first_orientation(p)


def job_progress(spark, sf):
    p = in_pages(spark, sf).withColumn("qc", F.col("qc") - 1).withColumn("page_progress", (F.col("page_num") * 37 % 100).cast("int"))
    return jobs.progress(p)


JOB_PROGRESS = PAGES + "SELECT job_id, round_even(sum(CASE WHEN qc = 0 THEN (page_num * 37 % 100) / 100.0::DOUBLE ELSE 1.0::DOUBLE END) * 100 / count(*), 0)::INT AS full_progress FROM p GROUP BY 1"


def in_events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("job_id"), "ts", stream.status_of(F.col("event_type")).alias("status"))


STATUS = "CASE event_type WHEN 'signup' THEN 'in pool' WHEN 'view' THEN 'waiting' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'ready' WHEN 'error' THEN 'exception' END"


def job_latest_status(spark, sf):
    return jobs.latest(in_events(spark, sf), "job_id", "ts", "event_id").select("job_id", "event_id", "status")


def job_queue_order(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 3 - 1).cast("int").alias("priority"), F.col("ts").alias("enqueued_at"))
    return jobs.queue_positions(e, "id").select("id", "priority", "pos")


def job_expired(spark, sf):
    e = table(spark, sf, "events").withColumn("end", F.date_trunc("hour", "ts") + F.expr("interval 1 hour"))
    return e.select("event_id", jobs.expired(F.col("ts"), F.col("end")).alias("expired"))


def result_ttl(spark, sf):
    e = in_events(spark, sf)
    now = e.agg(F.max("ts").alias("now"))  # one row
    return e.join(F.broadcast(now), F.col("ts") >= F.col("now") - F.expr("interval 2 hours")).select("event_id", "status")


def job_verdict(spark, sf):
    return jobs.verdict(in_pages(spark, sf))


# --- names ---


def in_gaz(spark, sf) -> DataFrame:
    n = table(spark, sf, "part").groupBy(F.col("p_name").alias("key")).agg(F.count("*").alias("n"))
    return n.select("key", F.row_number().over(W.orderBy(F.desc("n"), "key")).alias("id"), (F.length("key") % 3).alias("gender"))


def variants(spark, sf) -> DataFrame:
    n = F.col("p_name")
    p = table(spark, sf, "part").select("p_name").distinct()
    return p.select("p_name", F.concat(F.left(n, F.lit(2)), F.substr(n, F.lit(4))).alias("w0"), F.concat(F.left(n, F.lit(3)), F.lit("z"), F.substr(n, F.lit(5))).alias("w1"), F.concat(n, F.lit("qqqqqq zz")).alias("w2"))


def in_words(spark, sf) -> DataFrame:
    v = variants(spark, sf)
    return v.select(F.explode(F.array("w0", "w1", "p_name", F.lit("zz"), F.substr("p_name", F.lit(1), F.lit(3)))).alias("word")).distinct()


GAZ = """
WITH n AS (SELECT p_name AS key, count(*) AS n FROM part GROUP BY 1),
g AS (SELECT key, row_number() OVER (ORDER BY n DESC, key) AS id, length(key) % 3 AS gender FROM n),
v AS (SELECT DISTINCT p_name, substr(p_name, 1, 2) || substr(p_name, 4) AS w0, substr(p_name, 1, 3) || 'z' || substr(p_name, 5) AS w1 FROM part),
w AS (SELECT DISTINCT unnest([w0, w1, p_name, 'zz', substr(p_name, 1, 3)]) AS word FROM v),
c0 AS (SELECT word, id, key, gender, levenshtein(word, key) AS distance FROM w, g WHERE levenshtein(word, key) <= 3),
c1 AS (SELECT *, 4 - distance AS score, row_number() OVER (PARTITION BY word ORDER BY distance, id) AS n FROM c0),
c AS (SELECT * FROM c1 WHERE n <= 5),
t AS (SELECT word, arg_min({'id': id, 'key': key, 'gender': gender, 'score': score}, n) AS top, min({'id': id, 'key': key, 'gender': gender}) FILTER (distance = 0) AS l1,
  min({'id': id, 'key': key, 'gender': gender}) FILTER (distance = 1) AS l2, min({'id': id, 'key': key, 'gender': gender}) FILTER (distance = 2) AS l3 FROM c GROUP BY word),
a AS (SELECT word, CASE WHEN l1 IS NOT NULL AND l2 IS NOT NULL THEN CASE WHEN l1.id > 5000 * l2.id THEN l2.key ELSE l1.key END
  WHEN l2 IS NOT NULL AND l3 IS NOT NULL THEN CASE WHEN l2.id > 5000 * l3.id THEN l3.key ELSE l2.key END ELSE top.key END AS value,
  CASE WHEN l1 IS NOT NULL AND l2 IS NOT NULL THEN CASE WHEN l1.id > 5000 * l2.id THEN 0.75 WHEN l1.key = word THEN 1 ELSE 0.75 END ELSE top.score / 4 END::DOUBLE AS score FROM t),
p AS (SELECT a.*, ['UNKNOWN', 'MALE', 'FEMALE'][length(value) % 3 + 1] AS gender FROM a)
"""


def gazetteer_topk(spark, sf):
    return gazetteer.candidates(in_words(spark, sf), in_gaz(spark, sf)).select("word", "id", "key", "distance", "score", "n")


def gazetteer_pick(spark, sf):
    return gazetteer.pick(gazetteer.candidates(in_words(spark, sf), in_gaz(spark, sf)))


def gazetteer_double(spark, sf):
    v = variants(spark, sf).select(F.col("w0").alias("w1"), F.col("w1").alias("w2"))
    c = gazetteer.candidates(v.select(F.explode(F.array("w1", "w2")).alias("word")), in_gaz(spark, sf))
    return gazetteer.pick_double(c, c, v)


DOUBLE = GAZ + """, q AS (SELECT DISTINCT w0, w1 FROM v),
m AS (SELECT q.w0, q.w1, min({'n': a.n, 'key': a.key, 'gender': a.gender, 'score': a.score}) AS top FROM q JOIN c a ON a.word = q.w0 JOIN c b ON b.word = q.w1 AND a.key = b.key GROUP BY 1, 2),
j AS (SELECT q.w0, q.w1, top, p0, p1, i.key AS ikey, i.score AS iscore FROM q LEFT JOIN m USING (w0, w1) LEFT JOIN p p0 ON p0.word = q.w0 LEFT JOIN p p1 ON p1.word = q.w1 LEFT JOIN c i ON i.word = q.w0 AND i.n = 1),
d AS (SELECT w0, w1, CASE WHEN top IS NOT NULL AND top.key <> w0 AND top.key <> w1 AND p0.score = 1 THEN p0.value WHEN top IS NOT NULL AND top.key <> w0 AND top.key <> w1 AND p1.score = 1 THEN p1.value
  WHEN top IS NOT NULL THEN top.key WHEN p0 IS NOT NULL AND p1 IS NOT NULL THEN ikey ELSE coalesce(p0.value, p1.value) END AS value,
  CASE WHEN top IS NOT NULL AND top.key <> w0 AND top.key <> w1 AND (p0.score = 1 OR p1.score = 1) THEN 1 WHEN top IS NOT NULL THEN CASE WHEN top.key IN (w0, w1) THEN 1 ELSE top.score / 4 END
  WHEN p0 IS NOT NULL AND p1 IS NOT NULL THEN iscore / 4 ELSE coalesce(p0.score, p1.score) END::DOUBLE AS score FROM j)
SELECT w0 AS w1, w1 AS w2, value, CASE WHEN value IS NULL THEN NULL ELSE ['UNKNOWN', 'MALE', 'FEMALE'][length(value) % 3 + 1] END AS gender, score FROM d"""


def gazetteer_retry(spark, sf):
    v = table(spark, sf, "part").select(F.concat("p_name", F.lit("q qqqqqq zzzzzz")).alias("word"))
    return gazetteer.pick_retry(v, in_gaz(spark, sf))


RETRY = GAZ + """, q AS (SELECT DISTINCT p_name || 'q qqqqqq zzzzzz' AS word FROM part),
x AS (SELECT word, string_split(word, ' ') AS s FROM q), y AS (SELECT word, s, unnest(range(0, len(s) + 1)) AS rank FROM x),
z AS (SELECT word, rank, CASE WHEN rank = 0 THEN word ELSE array_to_string(s[1:len(s) - rank + 1], ' ') END AS part FROM y),
zc AS (SELECT DISTINCT part, id, key, levenshtein(part, key) AS distance FROM z, g WHERE levenshtein(part, key) <= 3),
zn AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY distance, id) AS n FROM zc),
zt AS (SELECT part, arg_min(key, n) AS topkey, min(distance) AS d, min({'id': id, 'key': key}) FILTER (distance = 0) AS l1, min({'id': id, 'key': key}) FILTER (distance = 1) AS l2,
  min({'id': id, 'key': key}) FILTER (distance = 2) AS l3 FROM zn WHERE n <= 5 GROUP BY part),
za AS (SELECT part, CASE WHEN l1 IS NOT NULL AND l2 IS NOT NULL THEN CASE WHEN l1.id > 5000 * l2.id THEN l2.key ELSE l1.key END
  WHEN l2 IS NOT NULL AND l3 IS NOT NULL THEN CASE WHEN l2.id > 5000 * l3.id THEN l3.key ELSE l2.key END ELSE topkey END AS value,
  CASE WHEN l1 IS NOT NULL AND l2 IS NOT NULL THEN CASE WHEN l1.id > 5000 * l2.id THEN 0.75 WHEN l1.key = part THEN 1 ELSE 0.75 END ELSE (4 - d) / 4 END::DOUBLE AS score FROM zt),
zb AS (SELECT word, arg_min({'value': value, 'score': score, 'rank': rank}, rank) AS b FROM z JOIN za USING (part) GROUP BY word)
SELECT word, b.value AS value, ['UNKNOWN', 'MALE', 'FEMALE'][length(b.value) % 3 + 1] AS gender, b.score - CASE WHEN b.rank > 0 THEN 0.25 ELSE 0 END AS score FROM zb"""


def suggest_accuracy(spark, sf):
    v = variants(spark, sf)
    got = gazetteer.pick(gazetteer.candidates(v.select(F.col("w1").alias("word")), in_gaz(spark, sf)))
    return v.join(got, v["w1"] == got["word"], "left").agg(F.avg(F.coalesce(F.col("value") == F.col("p_name"), F.lit(False)).cast("int")).alias("accuracy"))


# --- votes ---


def _view(i: int, n: int):
    return F.slice(F.col("embedding").cast("array<double>"), i * n + 1, n)


def argmax_logits(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", votes.argmax(votes.mean_of([_view(i, 5) for i in range(4)])).alias("cls"))


ARGMAX = "WITH e AS (SELECT vec_id, list_transform(range(1, 6), lambda i: ((embedding[i]::DOUBLE + embedding[i + 5]::DOUBLE) + embedding[i + 10]::DOUBLE) + embedding[i + 15]::DOUBLE) AS m FROM embeddings) SELECT vec_id, (list_position(m, list_max(m)) - 1)::INT AS cls FROM e"


def rotation_vote(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", votes.rotation_vote([_view(i, 4) for i in range(4)]).alias("turns"))


ROTATE = "WITH e AS (SELECT vec_id, list_transform(range(0, 4), lambda i: ((embedding[i + 1]::DOUBLE + embedding[4 + (i + 3) % 4 + 1]::DOUBLE) + embedding[8 + (i + 2) % 4 + 1]::DOUBLE) + embedding[12 + (i + 1) % 4 + 1]::DOUBLE) AS m FROM embeddings) SELECT vec_id, (list_position(m, list_max(m)) - 1)::INT AS turns FROM e"


def _scaled(at: int, by: float):
    """Three components, scaled so that the gates' limits divide the table."""
    return F.transform(_view(at, 3), lambda x: x * by)


def text_gate(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", votes.is_text(_scaled(0, 10)).alias("is_text"))


def handwriting_any(spark, sf):
    e = table(spark, sf, "embeddings").select("label", votes.is_handwritten(_scaled(0, 2.5)).alias("h"))
    return e.groupBy("label").agg(F.bool_or("h").alias("signed"), F.count_if("h").alias("n"))


def angle_mode_median(spark, sf):
    e = table(spark, sf, "embeddings").select("label", (F.get(F.col("embedding").cast("array<double>"), F.lit(0)) * 20).alias("a"))
    return votes.angle(e, ["label"], "a")


ANGLE = "WITH e AS (SELECT label, embedding[1]::DOUBLE * 20 AS a, round_even(embedding[1]::DOUBLE * 20, 0)::INT AS r FROM embeddings), g AS (SELECT label, r, count(*) AS n, median(a) AS m FROM e GROUP BY 1, 2) SELECT label, arg_max(r, {'n': n, 'r': -r}) AS angle, arg_max(m, {'n': n, 'r': -r}) AS median FROM g GROUP BY 1"


def substring10_vote(spark, sf):
    c = F.lpad(F.col("c_custkey").cast("string"), 10, "7")
    t = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("5"), F.repeat(c, 7))).when(F.col("c_custkey") % 3 == 1, F.repeat(c, 8)).otherwise(F.lit("12345"))
    return votes.substring_vote(spread(table(spark, sf, "customer").select("c_custkey")).select("c_custkey", t.alias("t")), ["c_custkey"], "t")


VOTE = """WITH t AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '5' || repeat(lpad(c_custkey::VARCHAR, 10, '7'), 7) WHEN 1 THEN repeat(lpad(c_custkey::VARCHAR, 10, '7'), 8) ELSE '12345' END AS t FROM customer),
w AS (SELECT c_custkey, t, unnest(range(0, 70)) AS p FROM t), x AS (SELECT c_custkey, t, p, substr(t, (p % 7) * 10 + p // 7 + 1, 10) AS w FROM w),
n AS (SELECT c_custkey, t, w, count(*) AS n, min(p) AS first FROM x WHERE length(w) = 10 GROUP BY 1, 2, 3 HAVING count(*) > 2),
b AS (SELECT c_custkey, arg_min(w, {'d': levenshtein(repeat(w, 8), t), 'f': first}) AS vote FROM n GROUP BY 1)
SELECT t.c_custkey, coalesce(vote, '') AS vote FROM t LEFT JOIN b USING (c_custkey)"""

# --- layout ---


def in_words_table(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line0", "l"))
    w = d.select("doc_id", "line0", F.posexplode(F.split("l", " ")).alias("word", "text"))
    return w.select("doc_id", (F.col("line0").cast("long") * 1000000 + F.col("word")).alias("idx"), (58 * F.col("line0") + F.col("word") * 7 % 13).alias("top"), (40 * F.col("word")).alias("left"), "text")


WORDS = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(0, len(string_split(text, chr(10))))) AS line0 FROM documents),
x AS (SELECT doc_id, line0, unnest(string_split(l, ' ')) AS text, unnest(range(0, len(string_split(l, ' ')))) AS word FROM l),
w AS (SELECT doc_id, line0 * 1000000 + word AS idx, (58 * line0 + word * 7 % 13)::INT AS top, (40 * word)::INT AS "left", text, line0 FROM x),
f AS (SELECT *, coalesce(lead(top) OVER (PARTITION BY doc_id ORDER BY idx) < top, false) AS over FROM w)
"""


def line_adjacent_fix(spark, sf):
    w = layout.blank_overtaken(in_words_table(spark, sf), ["doc_id"])
    return w.groupBy("doc_id").agg(F.count_if(F.col("text") == "").alias("blank"), F.sum(F.length("text")).alias("chars"))


def line_build(spark, sf):
    return layout.build_lines(in_words_table(spark, sf), ["doc_id"], 1555, 20)


LINES = WORDS + """, k AS (SELECT * FROM f WHERE NOT over AND "left" < 1555 AND length(text) > 1),
n AS (SELECT *, CASE WHEN top - lag(top) OVER (PARTITION BY doc_id ORDER BY idx) > 20 THEN 1 ELSE 0 END AS new FROM k),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY idx)::INT AS line FROM n)
SELECT doc_id, line, min(top) AS y, string_agg(text, ' ' ORDER BY idx) AS text FROM s GROUP BY 1, 2"""


def in_boxes(spark, sf) -> DataFrame:
    w = in_words_table(spark, sf).where("length(text) > 0")
    return w.select("doc_id", F.expr("cast(idx div 1000000 as int)").alias("line"), F.col("left").alias("x"), F.col("top").alias("y"), (8 * F.length("text")).alias("w"), F.lit(13).alias("h"))


BOXES = WORDS + """, b AS (SELECT doc_id, line0::INT AS line, "left" AS x, top AS y, 8 * length(text) AS w, 13 AS h FROM w WHERE length(text) > 0) """


def box_union(spark, sf):
    return layout.union_box(in_boxes(spark, sf), ["doc_id", "line"])


UNION_BOX = BOXES + "SELECT doc_id, line, min(x) AS x, min(y) AS y, (max(x + w) - min(x))::INT AS w, (max(y + h) - min(y))::INT AS h FROM b GROUP BY 1, 2"


def box_filter(spark, sf):
    b = in_boxes(spark, sf)
    zone, cell = layout.zone_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(100), F.lit(600)), layout.category_box(F.col("w"), F.col("h"))
    return b.groupBy("doc_id").agg(F.count_if(zone).alias("zones"), F.count_if(cell).alias("cells"))


def band_assign(spark, sf):
    b = in_words_table(spark, sf).select("doc_id", layout.assign_band(F.col("left"), F.col("top"), F.lit(55), F.lit(25)).alias("field")).where("field is not null")
    return b.groupBy("field").agg(F.count("*").alias("n"))


BAND = WORDS + ", b AS (SELECT CASE " + " ".join(f"WHEN abs(top - 25 - {dy}) < 17 AND \"left\" - 55 >= {lo} AND \"left\" - 55 < {hi} THEN '{n}'" for n, dy, lo, hi in layout.BANDS) + " END AS field FROM w) SELECT field, count(*) AS n FROM b WHERE field IS NOT NULL GROUP BY 1"


def line_cluster(spark, sf):
    boxes = layout.union_box(in_boxes(spark, sf), ["doc_id", "line"]).withColumn("idx", F.col("line").cast("long")).drop("line")
    return layout.cluster_lines(boxes, ["doc_id"], ws=10, hs=12)


def bottom_page(spark, sf):
    """Lines of a lower passport page for each customer, with what may be missing by key."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    texts = [F.lit("ПЕТР0В"), F.lit("ИВАН"), F.lit("ИЛЬИЧ."), F.concat(F.lit("МУЖ 0"), (F.col("k") % 9 + 1).cast("string"), F.lit(".05.1980")), F.lit("ГОР. ОМСК")]
    rows = F.array(*[F.struct(F.lit(y).alias("y"), F.concat(t, F.lit("")).alias("text")) for y, t in zip((100, 200, 300, 340, 380), texts)])
    lines = c.select("k", F.posexplode(rows).alias("line", "r")).select("k", "line", "r.y", "r.text").where("(k + line) % 4 != 0")
    return layout.bottom_page(lines, ["k"])


BOTTOM = """SELECT c_custkey AS k, CASE WHEN (c_custkey + 0) % 4 <> 0 THEN 'ПЕТРОВ' END AS F, CASE WHEN (c_custkey + 1) % 4 <> 0 THEN 'ИВАН' END AS I, CASE WHEN (c_custkey + 2) % 4 <> 0 THEN 'ИЛЬИЧ' END AS O,
  CASE WHEN (c_custkey + 3) % 4 <> 0 THEN '0' || (c_custkey % 9 + 1) || '.05.1980' END AS birth_date, CASE WHEN (c_custkey + 3) % 4 <> 0 THEN 'МУЖ' END AS gender, CASE WHEN (c_custkey + 4) % 4 <> 0 THEN 'ГОР. ОМСК' END AS birth_place FROM customer"""

# --- fusion ---


def in_struct(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    k, t = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    mrz = F.when(k % 3 != 0, F.struct(F.concat(F.lit("12"), t).alias("s_number"), (k % 2 == 0).alias("s_number_check"), F.lit("ЗЕТ").alias("mrz_f"), (k % 5 == 0).alias("mrz_f_check"), F.lit("ЮН").alias("mrz_i"), (k % 5 == 1).alias("mrz_i_check"), F.lit("О").alias("mrz_o"), (k % 5 == 2).alias("mrz_o_check"), F.lit("850214").alias("birth_date"), (k % 4 == 0).alias("birth_date_check"), F.lit("M").alias("gender"), (k % 7 == 0).alias("gender_check"), F.lit("190305").alias("issue_date"), F.lit("770012").alias("code"), (k % 11 == 0).alias("issue_date_and_code_check"), (k % 13 == 0).alias("final_check")))
    top = F.when(k % 4 < 2, F.struct(F.when(k % 8 == 0, "05.03.2019").alias("data_vid"), F.lit("770-012").alias("code_pod"), (k % 6 == 0).alias("code_pod_check"), F.lit("").alias("vidan")))
    bottom = F.when(k % 5 > 1, F.struct(F.when(k % 2 == 0, "НИЗ").alias("F"), F.lit("ИМЯ").alias("I"), F.lit("ОТЧ").alias("O"), F.when(k % 2 == 0, "1985").alias("birth_date"), F.when(k % 2 == 0, "МУЖ").otherwise("ЖЕН").alias("gender"), F.lit("ОМСК").alias("birth_place")))
    s = F.when(k % 2 == 1, F.struct(F.lit("СОВ").alias("F"), (k % 4 / 4.0).alias("F_score"), F.lit("И").alias("I"), F.lit(1.0).alias("I_score"), F.lit(None).cast("string").alias("O"), F.lit(1.0).alias("O_score"), F.lit("MALE").alias("F_gender"), F.when(k % 3 == 0, "MALE").otherwise("FEMALE").alias("I_gender")))
    return o.select(k.alias("k"), (k % 4).cast("int").alias("qc"), F.when(k % 6 != 0, F.concat(F.lit("4500"), t)).alias("serial_number"), (k % 6 == 1).alias("serial_number_check"), mrz.alias("MRZ"), top.alias("main_top_page"), bottom.alias("main_bottom_page"), s.alias("suggest"))


STRUCT = """WITH o AS (SELECT o_orderkey AS k, o_custkey::VARCHAR AS t, o_orderkey % 4 AS qc, CASE WHEN o_orderkey % 6 <> 0 THEN '4500' || o_custkey END AS sn, o_orderkey % 6 = 1 AS sc,
  o_orderkey % 3 <> 0 AS m, o_orderkey % 4 < 2 AS tp, o_orderkey % 5 > 1 AS bt, o_orderkey % 2 = 1 AS sg FROM orders) """


def fuse_passport(spark, sf):
    p = in_struct(spark, sf)
    f = fuse.passport({c: F.col(c) for c in p.columns}, 2024)
    cols = [F.col(f"{n}.{v}").alias(f"{n}_{v}") for n in f for v in ("value", "value_short", "trusted")]
    return p.select("k", *[v.alias(n) for n, v in f.items()]).select("k", *cols)


def _fuse_sql() -> str:
    t = lambda c: f"CASE WHEN qc <= 2 THEN {c} END"
    n = "NULL::VARCHAR"
    out = {
        "serial_number1": ("CASE WHEN sc THEN left(sn, 4) WHEN m AND k % 2 = 0 THEN NULL WHEN sn IS NOT NULL THEN left(sn, 4) END", "CASE WHEN NOT sc AND m AND k % 2 = 0 THEN left('12' || t, 3) END", "CASE WHEN sc OR (m AND k % 2 = 0) THEN 'True' WHEN sn IS NOT NULL THEN 'False' END"),
        "serial_number2": ("CASE WHEN sc THEN substr(sn, 5) WHEN m AND k % 2 = 0 THEN substr('12' || t, 4) WHEN sn IS NOT NULL THEN substr(sn, 5) END", n, "CASE WHEN sc OR (m AND k % 2 = 0) THEN 'True' WHEN sn IS NOT NULL THEN 'False' END"),
        "F": ("CASE WHEN m AND k % 5 = 0 THEN 'ЗЕТ' WHEN sg AND k % 4 = 3 THEN 'СОВ' WHEN bt THEN CASE WHEN k % 2 = 0 THEN 'НИЗ' END WHEN m THEN 'ЗЕТ' END", n, "CASE WHEN m AND k % 5 = 0 THEN 'True' WHEN sg AND k % 4 = 3 THEN 'Possible' WHEN bt THEN CASE WHEN k % 2 = 0 THEN 'False' END WHEN m THEN 'False' END"),
        "I": ("CASE WHEN m AND k % 5 = 1 THEN 'ЮН' WHEN sg THEN 'И' WHEN bt THEN 'ИМЯ' WHEN m THEN 'ЮН' END", n, "CASE WHEN m AND k % 5 = 1 THEN 'True' WHEN sg THEN 'Possible' WHEN bt OR m THEN 'False' END"),
        "O": ("CASE WHEN m AND k % 5 = 2 THEN 'О' WHEN bt THEN 'ОТЧ' WHEN m THEN 'О' END", n, "CASE WHEN m AND k % 5 = 2 THEN 'True' WHEN bt OR m THEN 'False' END"),
        "birth_date": ("CASE WHEN m AND k % 4 = 0 THEN '14.02.1985' WHEN bt AND k % 2 = 0 THEN NULL WHEN m THEN '14.02.1985' END", "CASE WHEN m AND k % 4 = 0 THEN NULL WHEN bt AND k % 2 = 0 THEN '1985' END", "CASE WHEN m AND k % 4 = 0 THEN 'True' WHEN (bt AND k % 2 = 0) OR m THEN 'False' END"),
        "gender": ("CASE WHEN m AND k % 7 = 0 THEN 'M' WHEN bt THEN CASE WHEN k % 2 = 0 THEN 'M' ELSE 'F' END END", n, "CASE WHEN m AND k % 7 = 0 THEN 'True' WHEN bt THEN 'False' END"),
        "issue_date": ("CASE WHEN m AND k % 11 = 0 THEN '05.03.2019' WHEN tp THEN CASE WHEN k % 8 = 0 THEN '05.03.2019' END WHEN m THEN '05.03.2019' END", n, "CASE WHEN m AND k % 11 = 0 THEN 'True' WHEN tp THEN CASE WHEN k % 8 = 0 THEN 'False' END WHEN m THEN 'False' END"),
        "code_pod": ("CASE WHEN m AND k % 11 = 0 THEN '770012' WHEN tp THEN '770-012' WHEN m THEN '770012' END", n, "CASE WHEN m AND k % 11 = 0 THEN 'True' WHEN tp THEN CASE WHEN k % 6 = 0 THEN 'True' ELSE 'False' END WHEN m THEN 'False' END"),
        "vidan": (n, n, n),
        "birth_place": ("CASE WHEN bt THEN 'ОМСК' END", n, n),
    }
    cols = [f"{t(e)} AS {name}_{v}" for name, es in out.items() for v, e in zip(("value", "value_short", "trusted"), es)]
    return STRUCT + "SELECT k, " + ", ".join(cols) + " FROM o"


def fuse_licence(spark, sf):
    o = in_struct(spark, sf)
    k, no = F.col("k"), F.lit(None).cast("string")
    p = {
        "qc": F.col("qc"), "side": F.when(k % 5 == 0, "back").otherwise("front"), "suggest": F.col("suggest"), "fam_rus": F.lit("РУС"), "fam_check": k % 2 == 1, "name_rus": F.when(k % 7 == 0, "").otherwise("ИВАН"), "name_check": k % 3 == 0,
        "p3": F.when(k % 2 == 0, "1990").otherwise("01.02.1990"), "birthplace3_rus": F.lit("ОМСК"), "birthplace3_check": k % 3 == 0, "p4a": F.lit("01.01.2015"), "p4b": no, "p4ab_check": k % 3 == 1, "p4c_rus": F.lit("ГИБДД"), "p4c_check": k % 2 == 0, "p8_rus": no, "p8_check": k % 2 == 0, "p5": F.lit("5566"), "s_number": F.lit("7788"),
    }
    f = fuse.licence(p)
    return o.select("k", *[v.alias(n) for n, v in f.items()]).select("k", *[F.col(f"{n}.{v}").alias(f"{n}_{v}") for n in ("F", "I", "birth_date", "issue_date", "serial_number", "gender") for v in ("value", "value_short", "trusted")])


LICENCE = STRUCT + """, l AS (SELECT *, qc <= 2 AS ok, qc <= 2 AND k % 5 <> 0 AS fr FROM o)
SELECT k, CASE WHEN fr THEN CASE WHEN sg AND k % 4 = 3 THEN 'СОВ' ELSE 'РУС' END END AS F_value, NULL::VARCHAR AS F_value_short, CASE WHEN fr THEN CASE WHEN sg AND k % 4 = 3 THEN 'Possible' ELSE 'False' END END AS F_trusted,
  CASE WHEN fr AND k % 7 <> 0 THEN CASE WHEN sg AND k % 3 <> 0 THEN 'И' ELSE 'ИВАН' END END AS I_value, NULL::VARCHAR AS I_value_short,
  CASE WHEN fr AND k % 7 <> 0 THEN CASE WHEN sg AND k % 3 = 0 THEN 'True' WHEN sg THEN 'Possible' ELSE 'False' END END AS I_trusted,
  CASE WHEN fr AND k % 2 = 1 THEN '01.02.1990' END AS birth_date_value, CASE WHEN fr AND k % 2 = 0 THEN '1990' END AS birth_date_value_short, NULL::VARCHAR AS birth_date_trusted,
  CASE WHEN fr THEN '01.01.2015' END AS issue_date_value, NULL::VARCHAR AS issue_date_value_short, CASE WHEN fr THEN CASE WHEN k % 3 = 1 THEN 'True' ELSE 'False' END END AS issue_date_trusted,
  CASE WHEN fr THEN '5566' WHEN ok THEN '7788' END AS serial_number_value, NULL::VARCHAR AS serial_number_value_short, NULL::VARCHAR AS serial_number_trusted,
  CASE WHEN fr AND sg AND k % 3 = 0 THEN 'M' END AS gender_value, NULL::VARCHAR AS gender_value_short, NULL::VARCHAR AS gender_trusted FROM l"""


def fuse_combined(spark, sf):
    o = table(spark, sf, "orders")
    a, b = (F.col("o_orderkey") % 5).cast("int"), (F.col("o_custkey") % 5).cast("int")
    return o.select("o_orderkey", fuse.combined(a, b).alias("c")).select("o_orderkey", "c.document_type", "c.qc")


COMBINED = "SELECT o_orderkey, CASE WHEN a >= 3 AND b >= 3 THEN 100 WHEN a >= 3 THEN 130 WHEN b >= 3 THEN 100 ELSE 140 END AS document_type, CASE WHEN a >= 3 AND b >= 3 THEN 4 WHEN a >= 3 THEN b WHEN b >= 3 THEN a ELSE (a + b) // 2 END::INT AS qc FROM (SELECT o_orderkey, o_orderkey % 5 AS a, o_custkey % 5 AS b FROM orders)"


def qc_passport(spark, sf):
    p = in_struct(spark, sf)
    c = F.col
    qc = fuse.passport_qc(c("MRZ"), [c("main_top_page.data_vid"), c("main_top_page.code_pod")], c("main_top_page").isNotNull(), [c("main_bottom_page.F"), c("main_bottom_page.birth_date")], c("main_bottom_page").isNotNull(), c("serial_number"))
    return p.select("k", qc.alias("qc"))


QC = STRUCT + "SELECT k, CASE WHEN NOT m AND NOT tp AND NOT bt AND sn IS NULL THEN 3 WHEN NOT m AND tp AND bt THEN CASE WHEN (k % 8 <> 0)::INT + 2 * (k % 2 <> 0)::INT > 2 THEN 2 ELSE 1 END WHEN m AND k % 13 = 0 THEN 0 ELSE 2 END AS qc FROM o"


def qc_licence(spark, sf):
    k = F.col("o_orderkey")
    checks = {n: k % d != 0 for n, d in (("fam", 2), ("name", 3), ("birthplace3", 5), ("p4c", 7), ("p8", 11))}
    return table(spark, sf, "orders").select("o_orderkey", fuse.licence_qc(checks, F.when(k % 4 != 0, F.array(F.lit("B")))).alias("qc"))


# --- streams and images ---


def _stream_events(spark, sf) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    raw = spark.readStream.schema(e.schema).option("pathGlobFilter", "*").parquet(f"{sf}/events.parquet*")
    return raw.select("event_id", F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), stream.status_of(F.col("event_type")).alias("status"))


def stream_job_state(spark, sf):
    return stream.run_available(stream.latest_state(_stream_events(spark, sf)), ["job_id"]).select("job_id", "status")


def stream_tumbling_status(spark, sf):
    t = stream.run_available(stream.tumbling_status(_stream_events(spark, sf)), ["window", "status"])
    return t.select(F.unix_timestamp("window.start").alias("start"), "status", "n")


def _job_events(e) -> DataFrame:
    """Events of jobs from rows of events: splits, progress with and without a type, results, ends and exceptions."""
    i, kind = F.col("event_id"), F.col("event_type")
    what = (
        F.when(kind == "signup", "split").when(kind.isin("view", "click"), "progress").when(kind == "purchase", F.when(i % 9 == 0, "final").otherwise("completed"))
        .when(kind == "error", F.when(i % 8 == 0, "exception").otherwise("completed"))
    )
    typed = F.when(kind == "click", i % 7 * 10).when(what == "completed", 100 + i % 5 * 10)
    return e.select(F.floor(F.col("user_id") / 4).alias("job_id"), i.alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), what.alias("kind"), (1 + i % 6).alias("pages"), (i % 5).alias("page"), typed.alias("document_type"), (i % 101).alias("page_progress"), (i % 5).alias("qc"))


def job_fold(spark, sf):
    return state.fold_events(_job_events(table(spark, sf, "events"))).withColumn("entries", F.to_json("entries", {"ignoreNullFields": "false"}))


JOB_FOLD = """
WITH e AS (
  SELECT *, event_id AS i, epoch_us(ts) // 1000 AS ms, user_id // 4 AS job,
    CASE event_type WHEN 'signup' THEN 'split' WHEN 'view' THEN 'progress' WHEN 'click' THEN 'progress' WHEN 'purchase' THEN CASE WHEN event_id % 9 = 0 THEN 'final' ELSE 'completed' END
      WHEN 'error' THEN CASE WHEN event_id % 8 = 0 THEN 'exception' ELSE 'completed' END END AS kind FROM events
), s AS (SELECT *, count(*) FILTER (kind = 'split') OVER (PARTITION BY job ORDER BY ms, i) AS epoch FROM e WHERE kind IS NOT NULL),
t AS (SELECT *, max(CASE WHEN kind = 'split' THEN 1 + i % 6 END) OVER (PARTITION BY job, epoch) AS total FROM s WHERE epoch > 0),
v AS (SELECT *, lag(ms) OVER (PARTITION BY job, epoch ORDER BY ms, i) AS before FROM t WHERE kind NOT IN ('progress', 'completed') OR i % 5 < total),
d AS (SELECT *, sum((coalesce(ms - before, 0) > 7200000)::INT) OVER (PARTITION BY job, epoch ORDER BY ms, i) AS dead, max(epoch) OVER (PARTITION BY job) AS newest FROM v),
w AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ms, i) AS n FROM d WHERE dead = 0 AND epoch = newest),
j AS (SELECT job, arg_max(kind, n) AS kind, max(total) AS total, max(ms) AS last_ms FROM w GROUP BY job),
p AS (SELECT *, (i % 5)::INT AS page, max(n) FILTER (kind = 'completed') OVER (PARTITION BY job, i % 5) AS done, min(n) OVER (PARTITION BY job, i % 5) AS first FROM w WHERE kind IN ('progress', 'completed')),
g AS (
  SELECT job, page, max(CASE WHEN n = done THEN 100 + i % 5 * 10 WHEN done IS NULL AND n = first AND event_type = 'click' THEN nullif(i % 7 * 10, 0) END) AS document_type,
    arg_max(i % 101, n) FILTER (done IS NULL OR n > done) AS page_progress, coalesce(max(i % 5) FILTER (n = done), -1) AS qc FROM p GROUP BY job, page
), a AS (
  SELECT job, sum(CASE WHEN qc = -1 THEN page_progress ELSE 100 END) AS parts,
    string_agg('{"page":' || page || ',"document_type":' || coalesce(document_type::VARCHAR, 'null') || ',"page_progress":' || coalesce(page_progress::VARCHAR, 'null') || ',"qc":' || qc || '}', ',' ORDER BY page) AS entries FROM g GROUP BY job
), r AS (
  SELECT job::VARCHAR AS job_id, CASE kind WHEN 'final' THEN 'ready' WHEN 'exception' THEN kind ELSE 'processing' END AS status, total::INT AS pages,
    round_even(coalesce(parts, 0) / total, 0)::INT AS full_progress, '[' || coalesce(entries, '') || ']' AS entries, last_ms FROM j LEFT JOIN a USING (job)
)
"""


def stream_job_progress(spark, sf):
    """All jobs after the last event, from the stream's updates: those alive with their pages, the others as expired."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    raw = spark.readStream.schema(e.schema).option("pathGlobFilter", "*").parquet(f"{sf}/events.parquet*")
    newest = stream.run_available(state.job_progress(_job_events(raw)), ["job_id"])
    now = e.agg(F.unix_millis(F.max(F.col("ts").cast("timestamp"))).alias("now"))
    jobs_now = newest.join(F.broadcast(now))  # one row
    jobs_now = jobs_now.withColumn("expired", F.col("expired") | (F.col("last_ms") + state.TTL * 1000 < F.col("now")))
    alive = lambda c: F.when(~F.col("expired"), c)
    return jobs_now.select("job_id", "last_ms", "expired", *[alive(F.col(c)).alias(c) for c in ("status", "pages", "full_progress")], alive(F.to_json("entries", {"ignoreNullFields": "false"})).alias("entries"))


JOB_STREAM = JOB_FOLD + """, n AS (SELECT *, last_ms + 7200000 < (SELECT max(epoch_us(ts) // 1000) FROM events) AS expired FROM r)
SELECT job_id, last_ms, expired, CASE WHEN NOT expired THEN status END AS status, CASE WHEN NOT expired THEN pages END AS pages,
  CASE WHEN NOT expired THEN full_progress END AS full_progress, CASE WHEN NOT expired THEN entries END AS entries FROM n"""


def result_store(spark, sf):
    """Results of jobs put in three batches, one of them twice, compacted at the time of the newest, and asked for by all jobs."""
    path, e = stream.shared_folder(spark), in_events(spark, sf)
    rows = e.select(F.col("job_id").cast("string").alias("key"), F.concat_ws(" ", "status", "event_id").alias("payload"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 3).alias("part"))
    for batch in (0, 1, 1, 2):
        store.put(rows.where(F.col("part") == batch), path, batch)
    now = F.lit(rows.agg(F.max("ts")).first()[0])
    store.compact(spark, path, now, ttl=86_400)
    return store.get(rows.select("key").distinct(), store.living(store.entries(spark, path), now, ttl=86_400))


RESULT_STORE = f"""WITH r AS (SELECT user_id::VARCHAR AS key, arg_max({STATUS} || ' ' || event_id, ts) AS payload, max(ts) AS ts FROM events GROUP BY 1),
a AS (SELECT *, ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY AS alive FROM r)
SELECT key, CASE WHEN alive THEN 200 ELSE 404 END::INT AS code, CASE WHEN alive THEN payload END AS payload, CASE WHEN NOT alive THEN '{{"status":"exception","description":"key not exists"}}' END AS error FROM a"""


def pdf_split(spark, sf):
    """PDF files of one to three pages for each supplier; some with two images on the last page, some with a small one."""

    def build(batches):
        for b in batches:
            files = []
            for k in b.s_suppkey.tolist():
                pages = [[pdf_inputs.gray(400 + n, 400 + k % 5, (k + n) % 256, predictor=k % 2 == 0)] for n in range(1 + k % 3)]
                if k % 7 == 0:
                    pages[-1] *= 2
                if k % 7 == 1:
                    pages[-1] = [pdf_inputs.gray(399, 500, 0)]
                files.append(pdf_inputs.document(pages, packed=k % 3 == 0, nested=k % 4 == 0))
            yield b.assign(job_id=b.s_suppkey.astype(str), file_name="a.pdf", file=files)[["job_id", "file_name", "file"]]

    files_in = spread(table(spark, sf, "supplier").select("s_suppkey")).mapInPandas(build, "job_id string, file_name string, file binary")
    return pdf.split_pdf(files_in).select("job_id", "page_num", "format", "width", "height", "reason")


PDF_SPLIT = """
WITH s AS (SELECT s_suppkey AS k, s_suppkey::VARCHAR AS job_id, 1 + s_suppkey % 3 AS n FROM supplier)
SELECT job_id, NULL::INT AS page_num, NULL::VARCHAR AS format, NULL::INT AS width, NULL::INT AS height, CASE k % 7 WHEN 0 THEN '2 images on a page' ELSE 'a small image' END AS reason FROM s WHERE k % 7 < 2
UNION ALL SELECT job_id, p::INT, 'png', (400 + p)::INT, (400 + k % 5)::INT, NULL FROM s, LATERAL (SELECT unnest(range(n)) AS p) WHERE k % 7 >= 2
"""


def _framed_pages(batches):
    """A page for each key, few at once: a page is some thousand times as large as its key."""
    for b in batches:
        for at in range(0, len(b), 64):
            keys, data = b[at : at + 64], []
            for k in keys.c_custkey.tolist():
                image = np.full((120, 160, 3), 235, np.uint8)
                boxes = [(3 + k % 20, 2 + k % 7, 30 + k % 5, 20), (70, 10 + k % 11, 60, 70 + k % 9), (80 if k % 4 == 0 else 10, 60 if k % 4 == 0 else 80, 20, 15)]
                for x, y, w, h in boxes[: 1 + k % 3]:
                    image[y : y + h, x : x + w] = (k % 40, k % 40, 210)
                    image[y + 2 : y + h - 2, x + 2 : x + w - 2] = 235
                data.append(image.tobytes())
            yield keys.assign(height=120, width=160, nChannels=3, data=data)


def red_frames(spark, sf):
    """Pages with one to three red frames for each customer; the second frame of some holds the third."""
    pages_in = spread(table(spark, sf, "customer").select("c_custkey")).mapInPandas(_framed_pages, "c_custkey long, height int, width int, nChannels int, data binary")
    return pixels.frames(pages_in, "c_custkey").select("c_custkey", F.concat_ws(",", F.col("box").cast("array<string>")).alias("box"), "error")


RED_FRAMES = """WITH k AS (SELECT c_custkey AS k FROM customer),
b AS (
  SELECT k, 4 + k % 20 AS x, 3 + k % 7 AS y, 28 + k % 5 AS w, 18 AS h FROM k UNION ALL SELECT k, 71, 11 + k % 11, 58, 68 + k % 9 FROM k WHERE k % 3 > 0
  UNION ALL SELECT k, 11, 81, 18, 13 FROM k WHERE k % 3 = 2 AND k % 4 <> 0
) SELECT k AS c_custkey, concat_ws(',', x, y, w, h) AS box, NULL::VARCHAR AS error FROM b"""


def recognize_fixture(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("job_id"), F.lit("a.pdf").alias("file_name"), F.regexp_replace("text", "\n", "\f").cast("binary").alias("file"))
    r = recognize.recognize(d, recognize.FixtureRecognizer)
    return r.groupBy("job_id").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"))


def _png(height: int, width: int, dark: tuple[int, int, int, int]) -> bytes:
    """A gray image with a dark box, as a PNG file."""
    import struct
    import zlib

    x, y, w, h = dark
    rows = b"".join(b"\0" + bytes(20 if y <= r < y + h and x <= c < x + w else 230 for c in range(width)) for r in range(height))
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def image_kernels(spark, sf):
    """Generated images and a broken one, read back through the image source."""
    folder = tempfile.mkdtemp()
    for i in range(4):
        with open(os.path.join(folder, f"{i}.png"), "wb") as f:
            f.write(_png(40, 60, (5 + i, 7, 20, 10)) if i < 3 else b"broken")
    images = files.read_images(spark, f"file://{folder}")
    k = recognize.page_kernels(images)
    return k.select(F.regexp_extract("origin", r"(\d)\.png", 1).alias("image"), "turn", F.array_join(F.col("box").cast("array<string>"), ",").alias("box"))


QUERIES = {
    "scan_documents": (scan_documents, "SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2"),
    "filter_ext": (filter_ext, FILTER_EXT),
    "strip_html_pages": (strip_html_pages, "SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \n\t]+', ' ', 'g')) AS text FROM pages"),
    "class_restrict": (class_restrict, CLASS_RESTRICT),
    "class_to_type": (class_to_type, CLASS_TYPE),
    "parser_dispatch": (parser_dispatch, PARSER),
    "rule_classify": (rule_classify, "WITH " + RULES + " SELECT o_orderkey, arg_min(id, prio)::BIGINT AS document_type, arg_min(description, prio) AS description FROM m GROUP BY o_orderkey"),
    "rule_hit_counts": (rule_hit_counts, "WITH " + RULES + " SELECT id, count(*) AS n FROM m GROUP BY id"),
    "rule_classify_rotations": (rule_classify_rotations, ROTATIONS),
    "continuation_mark": (continuation_mark, CONTINUATION),
    "first_orientation": (first_orientation, PAGES + "SELECT job_id, arg_min((page_num % 4)::INT, page_num) FILTER (qc > 2) AS orientation FROM p GROUP BY 1"),
    "job_progress": (job_progress, JOB_PROGRESS),
    "job_latest_status": (job_latest_status, f"SELECT user_id AS job_id, arg_max(event_id, {{'t': ts, 'e': event_id}}) AS event_id, arg_max({STATUS}, {{'t': ts, 'e': event_id}}) AS status FROM events GROUP BY 1"),
    "job_queue_order": (job_queue_order, "SELECT event_id AS id, (user_id % 3 - 1)::INT AS priority, row_number() OVER (ORDER BY user_id % 3 - 1 > 0 DESC, ts DESC, event_id DESC) AS pos FROM events"),
    "job_expired": (job_expired, "SELECT event_id, epoch(date_trunc('hour', ts) + INTERVAL 1 HOUR) - epoch(ts) > 700 AS expired FROM events"),
    "result_ttl": (result_ttl, f"SELECT event_id, {STATUS} AS status FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR"),
    "job_verdict": (job_verdict, PAGES + "SELECT job_id, CASE WHEN bool_or(qc IN (2, 3)) THEN 'bad' ELSE 'good' END AS verdict FROM p GROUP BY 1"),
    "gazetteer_topk": (gazetteer_topk, GAZ + "SELECT word, id, key, distance, score, n FROM c"),
    "gazetteer_pick": (gazetteer_pick, GAZ + "SELECT word, value, gender, score FROM p"),
    "gazetteer_double": (gazetteer_double, DOUBLE),
    "gazetteer_retry": (gazetteer_retry, RETRY),
    "suggest_accuracy": (suggest_accuracy, GAZ + "SELECT avg((coalesce(p.value = v.p_name, false))::INT) AS accuracy FROM v LEFT JOIN p ON p.word = v.w1"),
    "argmax_logits": (argmax_logits, ARGMAX),
    "rotation_vote": (rotation_vote, ROTATE),
    "text_gate": (text_gate, "SELECT vec_id, ((embedding[1]::DOUBLE * 10 + embedding[2]::DOUBLE * 10) + embedding[3]::DOUBLE * 10) / 3 > 0.3 AS is_text FROM embeddings"),
    "handwriting_any": (handwriting_any, "SELECT label, bool_or(h) AS signed, count(*) FILTER (h) AS n FROM (SELECT label, ((embedding[1]::DOUBLE * 2.5 + embedding[2]::DOUBLE * 2.5) + embedding[3]::DOUBLE * 2.5) / 3 > 0.5 AS h FROM embeddings) GROUP BY 1"),
    "angle_mode_median": (angle_mode_median, ANGLE),
    "substring10_vote": (substring10_vote, VOTE),
    "line_adjacent_fix": (line_adjacent_fix, WORDS + "SELECT doc_id, count(*) FILTER (over OR text = '') AS blank, sum(CASE WHEN over THEN 0 ELSE length(text) END)::BIGINT AS chars FROM f GROUP BY 1"),
    "line_build": (line_build, LINES),
    "box_union": (box_union, UNION_BOX),
    "box_filter": (box_filter, BOXES + "SELECT doc_id, count(*) FILTER (y > 300 AND w / h > 5 AND w / 100 > 0.5) AS zones, count(*) FILTER (w * h BETWEEN 800 AND 3100 AND w / h BETWEEN 0.4 AND 3.0) AS cells FROM b GROUP BY 1"),
    "band_assign": (band_assign, BAND),
    "line_cluster": (line_cluster, None),
    "bottom_page": (bottom_page, BOTTOM),
    "fuse_passport": (fuse_passport, _fuse_sql()),
    "fuse_licence": (fuse_licence, LICENCE),
    "fuse_combined": (fuse_combined, COMBINED),
    "qc_passport": (qc_passport, QC),
    "qc_licence": (qc_licence, "SELECT o_orderkey, CASE WHEN o_orderkey % 2 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 4 <> 0 THEN 0 WHEN o_orderkey % 4 <> 0 THEN 1 ELSE 2 END AS qc FROM orders"),
    "pdf_split": (pdf_split, PDF_SPLIT),
    "red_frames": (red_frames, RED_FRAMES),
    "result_store": (result_store, RESULT_STORE),
    "job_fold": (job_fold, JOB_FOLD + "SELECT * FROM r"),
    "stream_job_progress": (stream_job_progress, JOB_STREAM),
    "stream_job_state": (stream_job_state, f"SELECT user_id AS job_id, arg_max({STATUS}, {{'t': ts, 'e': event_id}}) AS status FROM events GROUP BY 1"),
    "stream_tumbling_status": (stream_tumbling_status, f"SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, {STATUS} AS status, count(*) AS n FROM events GROUP BY 1, 2"),
    "recognize_fixture": (recognize_fixture, "SELECT doc_id::VARCHAR AS job_id, len(string_split(text, chr(10))) AS pages, (length(text) - len(string_split(text, chr(10))) + 1)::BIGINT AS chars FROM documents"),
    "image_kernels": (image_kernels, None),
}
