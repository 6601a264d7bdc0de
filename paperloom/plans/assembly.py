"""Routing, envelopes and whole documents over inputs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import assembly as a
from paperloom.plans.base import table


def _null(kind: str = "string"):
    return F.lit(None).cast(kind)


def _orders(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))


def page_route(spark, sf):
    k = F.col("k")
    allowed = F.when(k % 5 == 0, F.array(F.lit(100))).when(k % 5 == 1, F.array(F.lit(130), F.lit(120))).when(k % 5 == 2, F.array().cast("array<int>"))
    seen = F.element_at(F.array(*map(F.lit, (100, 130, 140, 120, 0))), (k % 7 % 5 + 1).cast("int"))
    bar = F.when(k % 3 == 0, F.lit(0)).when(k % 3 == 1, F.lit(46))
    got = a.route(k % 11 == 0, allowed, F.when(k % 4 != 3, k % 4 == 0), bar, F.when(k % 13 != 0, F.lit(10)), seen)
    return _orders(spark, sf).select("k", got.alias("r")).select("k", "r.*")


ROUTE = """WITH o AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN [100] WHEN 1 THEN [130, 120] ELSE [] END AS c, [100, 130, 140, 120, 0][o_orderkey % 7 % 5 + 1] AS s,
  CASE WHEN o_orderkey % 3 = 1 THEN 46 ELSE 0 END AS b, CASE WHEN o_orderkey % 13 <> 0 THEN 10 ELSE 0 END AS t FROM orders),
w AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'barcode' WHEN len(c) > 0 THEN 'classes' WHEN k % 4 <> 0 THEN 'classes' WHEN b > 0 THEN 'barcode' ELSE 'text' END AS way FROM o)
SELECT k, way, CASE way WHEN 'barcode' THEN b WHEN 'text' THEN t ELSE CASE WHEN len(c) = 0 THEN s WHEN s = 140 AND c = [100] THEN 100 WHEN s = 140 AND c = [130, 120] THEN 130 WHEN list_contains(c, s) THEN s ELSE 0 END END::INT AS document_type FROM w"""


def page_envelope(spark, sf):
    k = F.col("k")
    parsed = F.when(k % 2 == 0, a.present(qc=k % 5, description=F.lit("Паспорт"))).otherwise(a.present(qc=F.lit(0)))
    error = F.when(k % 7 == 0, F.concat(F.lit("KeyError "), k.cast("string")))
    e = a.envelope(k % 3, F.when(k % 4 == 0, F.lit("found")), F.when(k % 6 == 1, k % 4), parsed, F.when(k % 5 == 0, k % 9), error)
    return _orders(spark, sf).withColumn("e", e).select("k", a.encoded(F.col("e")).alias("json"), F.col("e")["qc"].cast("int").alias("qc"))


ENVELOPE = """WITH o AS (SELECT o_orderkey AS k FROM orders), f AS (SELECT k, k % 7 = 0 AS bad, k % 3 AS t,
  CASE WHEN k % 7 <> 0 AND k % 2 = 0 THEN 'Паспорт' WHEN k % 4 = 0 THEN 'found' END AS d, CASE WHEN k % 7 = 0 THEN 4 WHEN k % 2 = 0 THEN k % 5 ELSE 0 END::INT AS qc FROM o)
SELECT k, qc, '{' || concat_ws(',', CASE WHEN d IS NOT NULL THEN '"description":"' || d || '"' END, '"document_type":' || t, CASE WHEN bad THEN '"exception":"ParserClass KeyError ' || k || '"' END,
  CASE WHEN k % 5 = 0 THEN '"page":' || k % 9 END, '"qc":' || qc, CASE WHEN k % 6 = 1 THEN '"text_doc_orientation":' || k % 4 END) || '}' AS json FROM f"""


def page_result(spark, sf):
    """Pages of fused and other types as they are reported, with objects, lists and numbers; some failed, some have parts only."""
    k, none = F.col("k"), F.lit(None).cast("string")
    kind = F.element_at(F.array(*map(F.lit, (100, 130, 140, 10, 0))), (k % 5 + 1).cast("int"))
    qc = (k % 7 % 6).cast("int")
    field = lambda has, v, short, trust: F.when(has, F.struct(v.alias("value"), short.alias("value_short"), trust.alias("trusted")))
    own = {"F": field(k % 3 != 0, F.lit("НИЗ"), none, F.when(k % 2 == 0, "True")), "birth_date": field(k % 3 == 1, none, F.lit("1985"), F.lit("False"))}
    drives = {"serial_number": field(k % 4 != 0, k.cast("string"), none, none)}
    cats = F.when(k % 4 == 1, F.array(F.lit("B"), F.lit("C1"))).when(k % 4 == 2, F.array().cast("array<string>"))
    error = F.when(k % 11 == 0, F.lit("KeyError k"))
    env = a.envelope(kind, F.lit("text"), F.when(k % 2 == 0, k % 4), a.present(qc=qc, exception=F.when(k % 13 == 0, "of a part")), k % 9, error)
    parts = F.when(k % 3 != 0, (k % 4).cast("int")), F.when(k % 2 == 0, F.lit(1))
    return _orders(spark, sf).withColumn("e", env).select("k", a.encoded(a.final_page(F.col("e"), kind, F.col("e")["qc"].cast("int"), F.lit("text"), own, drives, parts, cats)).alias("json"))


PAGE_RESULT = """WITH o AS (SELECT o_orderkey AS k, [100, 130, 140, 10, 0][o_orderkey % 5 + 1] AS t, CASE WHEN o_orderkey % 11 = 0 THEN 4 ELSE o_orderkey % 7 % 6 END AS qc FROM orders),
f AS (
  SELECT *, CASE WHEN k % 3 <> 0 THEN '"F":{' || CASE WHEN k % 2 = 0 THEN '"trusted":"True",' ELSE '' END || '"value":"НИЗ"}' END AS f,
    CASE WHEN k % 3 = 1 THEN '"birth_date":{"trusted":"False","value_short":"1985"}' END AS b, CASE WHEN k % 4 <> 0 THEN '"serial_number":{"value":"' || k || '"}' END AS s,
    CASE WHEN k % 4 = 1 THEN '"categories":{"value":["B","C1"]}' END AS c, '"description":"text"' AS d,
    CASE WHEN k % 11 = 0 THEN '"exception":"ParserClass KeyError k"' WHEN k % 13 = 0 THEN '"exception":"of a part"' END AS x FROM o
)
SELECT k, '{' || CASE WHEN t < 100 OR qc > 4 THEN concat_ws(',', d, '"document_type":' || t, x, '"page":' || k % 9, '"qc":' || qc, CASE WHEN k % 2 = 0 THEN '"text_doc_orientation":' || k % 4 END)
  WHEN qc = 4 THEN '"document_type":0,"qc":4' WHEN t = 100 THEN concat_ws(',', f, b, d, '"document_type":100', x, '"qc":' || qc) WHEN t = 130 THEN concat_ws(',', c, d, '"document_type":130', x, '"qc":' || qc, s)
  ELSE concat_ws(',', d, '"document_type":140', CASE WHEN k % 2 = 0 THEN '"driving_license":{' || concat_ws(',', c, '"qc":1', s) || '}' END, CASE WHEN k % 3 <> 0 THEN '"passport_main":{' || concat_ws(',', f, b, '"qc":' || k % 4) || '}' END, '"qc":' || qc) END || '}' AS json FROM f"""


def props_decode(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "k long").alias("p"))
    return e.select("event_id", F.col("p.k").alias("value"), F.to_json(F.struct(F.col("p.k").alias("k"))).alias("json"))


def page_simplified(spark, sf):
    k = F.col("k")
    kind = F.element_at(F.array(*map(F.lit, (100, 130, 140, 10, 0, 120))), (k % 6 + 1).cast("int"))
    got = a.simplified(kind, (k % 5).cast("int"))
    return _orders(spark, sf).select("k", got.alias("s")).select("k", "s.document_type", "s.qc", F.array_join("s.parts", "+").alias("parts"))


SIMPLIFIED = """WITH o AS (SELECT o_orderkey AS k, [100, 130, 140, 10, 0, 120][o_orderkey % 6 + 1] AS t, (o_orderkey % 5)::INT AS qc FROM orders)
SELECT k, CASE WHEN t >= 100 AND t <> 120 AND qc = 4 THEN 0 ELSE t END AS document_type, qc, CASE WHEN t < 100 OR t = 120 THEN NULL WHEN qc = 4 THEN '' WHEN t = 100 THEN 'passport' WHEN t = 130 THEN 'licence' ELSE 'passport+licence' END AS parts FROM o"""


def fill_missing(spark, sf):
    k = F.col("k")
    first = {"F": F.when(k % 3 == 0, F.lit("ПЕТРОВ")), "birth_place": F.when(k % 4 == 0, F.lit(""))}
    second = {"F": F.when(k % 2 == 0, F.lit("ИВАНОВ")), "birth_place": F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, F.lit("ОМСК"))}
    return _orders(spark, sf).select("k", *[v.alias(n.lower()) for n, v in a.filled(first, second).items()])


FILL = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'ПЕТРОВ' WHEN o_orderkey % 2 = 0 THEN 'ИВАНОВ' END AS f, CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN 'ОМСК' END AS birth_place FROM orders"


def zone_lines(spark, sf):
    d = table(spark, sf, "documents").withColumn("lines", F.split("text", "\n"))
    return d.select("doc_id", F.size(a.zone_lines(F.col("lines"))).alias("n"), F.coalesce(F.array_max(F.transform(a.zone_lines(F.col("lines")), lambda x: F.length(x))), F.lit(0)).alias("longest"))


ZONE = "WITH d AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(x) > 40) AS l FROM documents) SELECT doc_id, len(l)::INT AS n, coalesce(list_max(list_transform(l, lambda x: length(x))), 0)::INT AS longest FROM d"


def _passport_parts():
    """A passport of each customer, in which parts are absent, misread or too short, by remainders of the key."""
    k = F.col("k")
    zone = F.struct(
        F.when(k % 5 == 0, F.lit("Я")).when(k % 5 != 1, F.lit("ПЕТРОВ")).alias("f"), F.lit("ИВАН").alias("i"), F.when(k % 3 == 0, F.lit("")).otherwise(F.lit("ОЛЕГОВИЧ")).alias("o"), F.lpad(k.cast("string"), 10, "4").alias("s_number"),
        F.element_at(F.array(F.lit("M"), F.lit("F"), _null()), (k % 3 + 1).cast("int")).alias("gender"), F.lit("770012").alias("code"), (k % 13 == 0).alias("gender_check"), (k % 2 == 0).alias("final_check"),
    )
    top = F.struct(F.when(k % 7 != 0, F.lit("УВД ОМСКА")).alias("vidan"), F.when(k % 7 != 1, F.lit("05.03.2019")).alias("data_vid"), F.when(k % 7 < 4, F.lit("770-012")).when(k % 7 == 4, F.lit("770-013")).alias("code_pod"))
    bottom = F.struct(
        F.when(k % 5 == 0, F.lit("Я")).when(k % 10 != 3, F.lit("ПЕТРОВ")).alias("F"), F.when(k % 4 != 0, F.lit("ИВАН")).alias("I"), F.when(k % 3 != 1, F.lit("ОЛЕГОВИЧ")).alias("O"),
        F.element_at(F.array(F.lit("МУЖ"), F.lit("ЖЕН"), _null(), F.lit("МУЖ")), (k % 4 + 1).cast("int")).alias("gender"), F.when(k % 6 == 0, F.lit("01.02.1980")).alias("birth_date"), F.when(k % 6 < 3, F.lit("ОМСК")).alias("birth_place"),
    )
    serial = F.when(k % 9 == 0, F.lit("")).when(k % 9 == 1, _null()).when(k % 9 < 5, F.lpad(k.cast("string"), 10, "4")).otherwise(F.lpad(k.cast("string"), 10, "5"))
    return F.when(k % 8 >= 3, zone), F.when(k % 16 != 1, top), F.when(k % 16 < 14, bottom), F.when(k % 32 != 1, serial), k % 6 == 5


def _customers(spark, sf):
    names = ("zone", "top", "bottom", "serial", "checked")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).select("k", *[c.alias(n) for n, c in zip(names, _passport_parts())])


def passport_page(spark, sf):
    c = F.col
    got = a.passport(c("zone"), c("top"), c("bottom"), c("serial"), c("checked"))
    return _customers(spark, sf).select("k", *[v.alias(n) for n, v in got.items()])


PASSPORT_PARTS = """WITH c AS (SELECT c_custkey AS k FROM customer), p AS (SELECT k, k % 8 >= 3 AS z, k % 16 <> 1 AS t, k % 16 < 14 AS b,
  CASE WHEN k % 5 = 0 THEN 'Я' WHEN k % 5 <> 1 THEN 'ПЕТРОВ' END AS zf, 'ИВАН' AS zi, CASE WHEN k % 3 = 0 THEN '' ELSE 'ОЛЕГОВИЧ' END AS zo, ['M', 'F', NULL][k % 3 + 1] AS zg, lpad(k::VARCHAR, 10, '4') AS zs,
  CASE WHEN k % 7 <> 0 THEN 'УВД ОМСКА' END AS vidan, CASE WHEN k % 7 <> 1 THEN '05.03.2019' END AS data_vid, CASE WHEN k % 7 < 4 THEN '770-012' WHEN k % 7 = 4 THEN '770-013' END AS code,
  CASE WHEN k % 5 = 0 THEN 'Я' WHEN k % 10 <> 3 THEN 'ПЕТРОВ' END AS bf, CASE WHEN k % 4 <> 0 THEN 'ИВАН' END AS bi, CASE WHEN k % 3 <> 1 THEN 'ОЛЕГОВИЧ' END AS bo, ['МУЖ', 'ЖЕН', NULL, 'МУЖ'][k % 4 + 1] AS bg,
  CASE WHEN k % 6 = 0 THEN '01.02.1980' END AS bd, CASE WHEN k % 6 < 3 THEN 'ОМСК' END AS bp,
  CASE WHEN k % 32 = 1 OR k % 9 IN (0, 1) THEN NULL WHEN k % 9 < 5 THEN lpad(k::VARCHAR, 10, '4') ELSE lpad(k::VARCHAR, 10, '5') END AS s FROM c)
"""
PASSPORT = (
    PASSPORT_PARTS
    + """, q AS (SELECT *, (vidan IS NULL)::INT + (data_vid IS NULL)::INT + (code IS NULL)::INT + (bf IS NULL)::INT + (bi IS NULL)::INT + (bo IS NULL)::INT + (bg IS NULL)::INT + (bd IS NULL)::INT + (bp IS NULL)::INT AS missing FROM p)
SELECT k, CASE WHEN NOT z AND NOT t AND NOT b AND s IS NULL THEN 3 WHEN NOT z AND t AND b THEN CASE WHEN missing > 5 THEN 2 ELSE 1 END WHEN z AND k % 2 = 0 THEN 0 ELSE 2 END AS qc,
  CASE WHEN z THEN b AND coalesce(zf = bf AND length(zf) > 1, false) END AS f_check, CASE WHEN z THEN b AND coalesce(zi = bi, false) END AS i_check, CASE WHEN z THEN b AND zo <> '' AND coalesce(zo = bo, false) END AS o_check,
  CASE WHEN z THEN k % 13 = 0 OR (b AND (coalesce(zg = 'F' AND bg = 'ЖЕН', false) OR coalesce(zg = 'M' AND bg = 'МУЖ', false))) END AS gender_check,
  s AS serial_number, s IS NOT NULL AND (k % 6 = 5 OR (z AND s = zs)) AS serial_number_check, CASE WHEN t THEN z AND coalesce(code = '770-012', false) END AS code_pod_check FROM q"""
)


def suggestion_ways(spark, sf):
    got = a.suggestion_ways(F.col("zone"), F.col("bottom"))
    return _customers(spark, sf).select("k", *[F.concat_ws(":", v["way"], v["first"], v["second"]).alias(n.lower()) for n, v in got.items()])


WAYS = (
    PASSPORT_PARTS
    + """, r AS (SELECT k, CASE WHEN z THEN zf END AS zf, CASE WHEN z THEN zi END AS zi, CASE WHEN z AND zo <> '' THEN zo END AS zo, CASE WHEN b THEN bf END AS bf, CASE WHEN b THEN bi END AS bi, CASE WHEN b THEN bo END AS bo FROM p)
SELECT k, CASE WHEN zf IS NOT NULL AND bf IS NOT NULL THEN 'double:' || zf || ':' || bf WHEN bf IS NOT NULL THEN 'retry:' || bf WHEN zf IS NOT NULL THEN 'retry:' || zf ELSE '' END AS f,
  CASE WHEN zi IS NOT NULL AND bi IS NOT NULL THEN 'double:' || zi || ':' || bi WHEN bi IS NOT NULL THEN 'retry:' || bi WHEN zi IS NOT NULL THEN 'retry:' || zi ELSE '' END AS i,
  CASE WHEN zo IS NOT NULL THEN 'retry:' || zo WHEN bo IS NOT NULL THEN 'retry:' || bo ELSE '' END AS o FROM r"""
)


def licence_page(spark, sf):
    """Three attempts at a licence for each order, of which the first good one counts."""
    k = F.col("k")
    counts = F.array(*[(k * m % 7).cast("int") for m in (1, 2, 3, 4, 5, 6)])
    o = _orders(spark, sf).withColumn("counts", F.when(k % 17 == 0, F.transform(counts, lambda x: x * 0)).otherwise(counts))
    tries = [a.licence(F.col("counts"), F.when((k + i) % 4 != 0, (k + i) % 3), F.when((k + i) % 5 != 0, F.lit("4512345678"))) for i in range(3)]
    o = o.withColumn("tries", F.array(*tries))
    o = o.withColumn("n", a.chosen_attempt(F.transform("tries", lambda t: t["qc"])))
    return o.select("k", a.best_template(F.col("counts")).alias("template"), F.col("n").alias("attempt"), F.col("tries")[F.col("n")].alias("t")).select("k", "template", "attempt", "t.*")


LICENCE_PAGE = """WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 17 = 0 THEN [0, 0, 0, 0, 0, 0] ELSE list_transform([1, 2, 3, 4, 5, 6], lambda m: o_orderkey * m % 7) END AS c FROM orders),
b AS (SELECT k, CASE WHEN list_max(c) > 0 THEN list_position(c, list_max(c)) - 1 END AS template FROM o), i AS (SELECT *, unnest([0, 1, 2]) AS attempt FROM b),
t AS (SELECT *, CASE WHEN template IS NULL THEN 'Fail to match driver license to templates.' WHEN template < 2 AND (k + attempt) % 4 = 0 THEN 'Fail to detect front side of Driving License.' WHEN template >= 2 AND (k + attempt) % 5 = 0 THEN 'Fail to detect back side of Driving License.' END AS exception FROM i),
q AS (SELECT *, CASE WHEN exception IS NOT NULL THEN 4 WHEN template < 2 THEN (k + attempt) % 3 ELSE 1 END::INT AS qc FROM t)
SELECT k, template::INT AS template, attempt, CASE WHEN exception IS NULL THEN CASE WHEN template < 2 THEN 'front' ELSE 'back' END END AS side, qc, exception FROM q
QUALIFY row_number() OVER (PARTITION BY k ORDER BY CASE WHEN qc < 2 THEN attempt ELSE 10 - attempt END) = 1"""


def reading_attempt(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("n", F.transform(F.slice("embedding", 1, 12), lambda x: F.floor(F.abs(x) * 1000).cast("int")))
    return e.select("vec_id", a.reading_attempt(F.col("n"), 320).alias("attempt"))


ATTEMPT = """WITH e AS (SELECT vec_id, list_transform(embedding[1:10], lambda x: floor(abs(x) * 1000)::INT) AS n FROM embeddings)
SELECT vec_id, CASE WHEN list_max(n) < 160 THEN NULL WHEN list_max(n) > 320 THEN list_position(list_transform(n, lambda x: x > 320), true) - 1 ELSE list_position(n, list_max(n)) - 1 END::INT AS attempt FROM e"""


def handwriting_fields(spark, sf):
    k = F.col("k")
    kind = F.element_at(F.array(*map(F.lit, (10, 45, 42, 40, 46, 43, 41, 44))), (k % 8 + 1).cast("int"))
    pieces = F.array(*[F.array(*[(k * m + j) % 5 == 0 for j in range(1 + m % 2)]) for m in (1, 2, 3, 4)])
    got = a.handwriting(kind, k % 4, F.when(k % 9 != 0, F.lit(3)), F.when(k % 19 != 0, pieces))
    fields = F.array_join(F.transform(F.array_sort(F.map_entries("h.text_doc_fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return _orders(spark, sf).select("k", kind.alias("document_type"), got.alias("h")).select("k", "document_type", "h.qc", fields.alias("fields"))


HANDWRITING = """WITH o AS (SELECT o_orderkey AS k, [10, 45, 42, 40, 46, 43, 41, 44][o_orderkey % 8 + 1] AS t, o_orderkey % 4 = 3 AND o_orderkey % 9 <> 0 AS last FROM orders),
p AS (SELECT *, (k + 0) % 5 = 0 OR (k + 1) % 5 = 0 AS a, (2 * k) % 5 = 0 AS b, (3 * k) % 5 = 0 OR (3 * k + 1) % 5 = 0 AS c, (4 * k) % 5 = 0 AS d FROM o),
f AS (SELECT k, t, CASE WHEN k % 19 = 0 THEN NULL WHEN t = 10 THEN 'signature1=' || a WHEN t = 45 THEN 'signature1=' || (b OR c) WHEN t = 42 THEN 'signature1=' || a || ',signature2=' || b
  WHEN t = 40 AND k % 4 = 3 THEN 'FIO=' || c || ',signature1=' || b || ',signature2=' || d || ',some_text_field=' || a WHEN t = 46 AND last THEN 'signature1=' || a || ',signature2=' || b || ',signature3=' || c
  WHEN t = 46 OR (t IN (43, 41) AND last) THEN 'signature1=' || a || ',signature2=' || b END AS fields FROM p)
SELECT k, t AS document_type, CASE WHEN fields IS NULL THEN 1 ELSE 0 END AS qc, fields FROM f"""


def signature_rectangles(spark, sf):
    k = F.col("k")
    kind = F.element_at(F.array(*map(F.lit, (46, 43, 41, 10))), (k % 4 + 1).cast("int"))
    r = a.signature_rectangles(kind, k % 3, F.lit(2), (k % 900 + 300).cast("int"))
    return _orders(spark, sf).select("k", F.array_join(F.transform(r, lambda x: F.concat_ws("/", x["x"], x["y"], x["w"], x["h"])), ",").alias("r"))


RECTANGLES = """WITH o AS (SELECT o_orderkey AS k, [46, 43, 41, 10][o_orderkey % 4 + 1] AS t, o_orderkey % 3 = 2 AS last, o_orderkey % 900 + 300 AS y FROM orders)
SELECT k, CASE WHEN t = 46 AND last THEN '50/' || y - 150 || '/200/70,530/' || y - 150 || '/170/70,750/' || y - 90 || '/170/70' WHEN t = 46 OR (t = 41 AND last) THEN '40/' || y - 100 || '/300/150,500/' || y - 100 || '/300/150'
  WHEN t = 43 AND last THEN '40/' || y - 230 || '/300/120,600/' || y - 230 || '/300/120' END AS r FROM o"""


def rectangle_order(spark, sf):
    k = F.col("k")
    rects = F.array(*[F.struct((k * m % 50).cast("int").alias("x"), (k * (m + 3) % 40).cast("int").alias("y"), F.lit(m).alias("w"), F.lit(9).alias("h")) for m in (1, 2, 3, 4)])
    o = _orders(spark, sf).select("k", F.when(k % 2 == 0, 42).otherwise(40).alias("t"), rects.alias("r"))
    return o.select("k", F.array_join(F.transform(a.ordered_rectangles(F.col("r"), F.col("t")), lambda x: x["w"].cast("string")), "").alias("o"))


ORDER = """WITH o AS (SELECT o_orderkey AS k, unnest([1, 2, 3, 4]) AS m FROM orders) SELECT k, string_agg(m::VARCHAR, '' ORDER BY CASE WHEN k % 2 = 0 THEN k * m % 50 ELSE k * (m + 3) % 40 END, m) AS o FROM o GROUP BY k"""


def page_file_order(spark, sf):
    f = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.concat(F.lit("/in/p"), (F.col("l_linenumber") * 7).cast("string"), F.lit(".png")).alias("path"))
    return a.page_files(f.distinct(), "job_id", "path", 7).withColumn("log", a.log_line(F.col("job_id").cast("string"), F.col("path")))


FILES = """WITH f AS (SELECT DISTINCT l_orderkey AS job_id, '/in/p' || l_linenumber * 7 || '.png' AS path FROM lineitem)
SELECT job_id, path, (row_number() OVER (PARTITION BY job_id ORDER BY path) - 1)::INT AS page_num, CASE WHEN count(*) OVER (PARTITION BY job_id) >= 7 THEN 'ValueError' END AS exception, job_id || ':' || path AS log FROM f"""


def box_scale(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    box = F.struct((F.col("k") % 50).alias("x"), (F.col("s") * 2).alias("y"), F.col("s").alias("w"), (F.col("k") % 13).alias("h"))
    return p.select("k", a.scaled_box(box, F.lit(5), F.lit(2.5), F.lit(1.5)).alias("b")).select("k", "b.*")


SCALE = "SELECT p_partkey AS k, round_even((p_partkey % 50 + 5) * 2.5, 0)::INT AS x, round_even((p_size * 2 + 5) * 1.5, 0)::INT AS y, round_even(p_size * 2.5, 0)::INT AS w, round_even((p_partkey % 13) * 1.5, 0)::INT AS h FROM part"


def point_read(spark, sf):
    asked = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.when(F.col("o_orderkey") % 7 == 1, "").otherwise("j"), F.when(F.col("o_orderkey") % 7 != 1, F.col("o_custkey").cast("string")).otherwise(""))).alias("job_id"))
    results = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("j"), F.col("c_custkey").cast("string")).alias("job_id"), F.col("c_name").alias("payload"))
    return a.point_reads(asked, results).groupBy("code").agg(F.count("*").alias("n"), F.count_distinct("payload").alias("payloads"))


READ = """WITH q AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN '' ELSE 'j' || o_custkey END AS id FROM orders), r AS (SELECT 'j' || c_custkey AS id, c_name FROM customer WHERE c_custkey % 3 = 0)
SELECT CASE WHEN coalesce(q.id, '') = '' THEN 400 WHEN r.id IS NULL THEN 404 ELSE 200 END AS code, count(*) AS n, count(DISTINCT c_name) AS payloads FROM q LEFT JOIN r ON q.id = r.id GROUP BY 1"""

QUERIES = {
    "page_route": (page_route, ROUTE),
    "page_envelope": (page_envelope, ENVELOPE),
    "page_result": (page_result, PAGE_RESULT),
    "props_decode": (props_decode, "SELECT event_id, (props::JSON->>'k')::BIGINT AS value, '{\"k\":' || (props::JSON->>'k') || '}' AS json FROM events"),
    "page_simplified": (page_simplified, SIMPLIFIED),
    "fill_missing": (fill_missing, FILL),
    "zone_lines": (zone_lines, ZONE),
    "passport_page": (passport_page, PASSPORT),
    "suggestion_ways": (suggestion_ways, WAYS),
    "licence_page": (licence_page, LICENCE_PAGE),
    "reading_attempt": (reading_attempt, ATTEMPT),
    "handwriting_fields": (handwriting_fields, HANDWRITING),
    "signature_rectangles": (signature_rectangles, RECTANGLES),
    "rectangle_order": (rectangle_order, ORDER),
    "page_file_order": (page_file_order, FILES),
    "box_scale": (box_scale, SCALE),
    "point_read": (point_read, READ),
}
