"""The registered queries of the operators, with production parameters, and the SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import chat, decontam, fim, knn, langid, lexical, linededup, lm, mixing, pii, sharding, simhash, warc


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), width=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    allocation, targets = mixing.mix(read(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), share=1.5, cap=2.0)
    taken = mixing.taken_rows(allocation, targets)
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(read(spark, sf_dir, "conversations"))


def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup(read(spark, sf_dir, "documents"), divisor=4, long=50)
    return found.select("doc_id", "removed_passages", "removed_lines", "kept_text")


OP4_SQL = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM l),
x AS (
  SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS after,
    16 * (strpos('0123456789abcdef', substr(md5(line), 1, 1)) - 1) + strpos('0123456789abcdef', substr(md5(line), 2, 1)) - 1 AS d,
    len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words FROM e
), p AS (SELECT doc_id, i, (31 * d + lead(d) OVER (PARTITION BY doc_id ORDER BY i)) % 4 = 0 AS cut, after IS NOT NULL AND count(*) OVER (PARTITION BY line, after) > 1 AS twice,
  words >= 50 AND count(*) OVER (PARTITION BY line) > 1 AS alone FROM x),
q AS (
  SELECT doc_id, i, twice AS begins, coalesce(lag(twice) OVER (PARTITION BY doc_id ORDER BY i), false) AS ends, cut AND twice AS cut, alone FROM p
), r AS (
  SELECT doc_id, i, NOT ends OR (begins AND cut AND lag(ends) OVER w AND NOT lag(cut) OVER w) AS starts FROM q WHERE begins OR ends OR alone
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), n AS (SELECT doc_id, i, sum(starts::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS number FROM r),
c AS (
  SELECT doc_id, number, min(i) AS s, max(i) AS z, string_agg(line, chr(10) ORDER BY i) AS chunk FROM n JOIN e USING (doc_id, i) GROUP BY doc_id, number
), g AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, s) > 1 AS later FROM c),
m AS (SELECT e.doc_id, e.i, e.line, g.s FROM e LEFT JOIN g ON later AND e.doc_id = g.doc_id AND e.i BETWEEN g.s AND g.z),
o AS (
  SELECT doc_id, count(DISTINCT s) AS removed_passages, count(s) AS removed_lines,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (s IS NULL), '') AS kept_text FROM m GROUP BY doc_id
)
SELECT d.doc_id, coalesce(removed_passages, 0) AS removed_passages, coalesce(removed_lines, 0) AS removed_lines, kept_text
FROM documents d LEFT JOIN o USING (doc_id)
"""


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(read(spark, sf_dir, "documents"), 24, more=8)
    # the law is not `key`, so grown_shard is null; the edit of the stored map for 8 shards more is next_shard
    none = F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", none, F.col("grown_shard").alias("next_shard"), "virtual_slot", "map_version")


def pii_digest(docs: DataFrame) -> DataFrame:
    found = pii.find(docs, ["doc_id"])
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.concat("base", "added")).alias("spans"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(read(spark, sf_dir, "documents"))


def crawl_records(pages: DataFrame) -> DataFrame:
    """Crawl records of pages, which hold no revisits: each page is a full response, captured at page_id minutes, and
    is asked for again some hours later under a variant of its URL, answered as not modified; one answer in five has another etag."""
    start, tag = F.lit("2024-01-01 00:00:00").cast("timestamp"), F.md5(F.col("html").cast("binary"))
    at = F.timestamp_add("MINUTE", F.col("page_id").cast("int"), start)
    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", at.alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"),
        F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("date"), F.col("page_id").cast("string"), F.lit("etag"), tag).alias("headers"),
    )
    seen = F.when(F.col("page_id") % 5 == 0, F.lit("stale")).otherwise(tag)
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"),
        F.timestamp_add("HOUR", (F.col("page_id") % 7 + 1).cast("int"), at).alias("ts"), F.lit("revisit").alias("kind"), seen.alias("etag"),
        F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("Date"), F.concat(F.lit("again "), F.col("page_id").cast("string")), F.lit("Content-Length"), F.lit("0")).alias("headers"),
    )
    return response.unionByName(revisit)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.resolve(crawl_records(read(spark, sf_dir, "pages")))
    heads = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return got.select("record_id", "canonical", F.unix_timestamp("ts").alias("ts"), "refers_to", "status", heads.alias("headers"))


OP7_SQL = r"""
WITH u AS (SELECT page_id, md5(html) AS tag, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
x AS (
  SELECT page_id, tag, regexp_replace(lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)), '^https$', 'http') AS scheme,
    regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM u
), y AS (
  SELECT page_id, tag, scheme,
    regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^(?:www\.|m\.)', ''), ':(?:80|443)$', '') AS host,
    regexp_replace(regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/index\.html?$', '/'), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
      lambda a: a <> '' AND NOT regexp_matches(a, '^(?:utm_[^=]*|ref|fbclid|gclid)(?:=|$)'))) AS args FROM x
), c AS (
  SELECT page_id, tag, CASE WHEN scheme = '' THEN 'http' ELSE scheme END || '://' || host || path
    || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS canonical FROM y
), p AS (SELECT page_id * 2 AS id, page_id, canonical, 1704067200 + page_id * 60 AS ts, tag FROM c),
v AS (
  SELECT page_id * 2 + 1 AS record_id, page_id, canonical, 1704067200 + page_id * 60 + (page_id % 7 + 1) * 3600 AS ts,
    CASE WHEN page_id % 5 = 0 THEN 'stale' ELSE tag END AS tag FROM c
), m AS (
  SELECT v.record_id, v.page_id, v.canonical, v.ts, v.tag, max({'ts': p.ts, 'id': p.id, 'tag': p.tag}) AS f
  FROM v LEFT JOIN p ON v.canonical = p.canonical AND p.ts < v.ts GROUP BY ALL
)
SELECT record_id, canonical, ts::BIGINT AS ts, f.id AS refers_to,
  CASE WHEN f.id IS NULL THEN 'no_response' WHEN f.tag = tag THEN 'resolved' ELSE 'validator_mismatch' END AS status,
  CASE WHEN f.tag = tag THEN 'content-type=text/html;date=again ' || page_id || ';etag=' || f.tag END AS headers
FROM m
"""


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs, ~held & F.col("doc_id").isNotNull(), sample_key=F.col("doc_id"))
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return langid.predict(rows, model, ["doc_id", "held_out"])


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), width=5, threshold=0.8)
    return found.select("doc_id", "item_id", "shared", "item_shingles", "containment")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), ds AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
    ELSE [array_to_string(w, ' ')] END) AS s FROM d WHERE len(w) > 0
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), bs AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
    ELSE [array_to_string(w, ' ')] END) AS s FROM b WHERE len(w) > 0
), q AS (SELECT item_id, count(*) AS item_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, item_shingles, count(*) / item_shingles AS containment
FROM ds JOIN bs USING (s) JOIN q USING (item_id)
GROUP BY doc_id, item_id, item_shingles HAVING 5 * count(*) >= 4 * item_shingles
"""


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


OP10_SQL = """
WITH e AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score, q.r AS qr, x.r AS xr
  FROM e q JOIN e x ON q.r <> x.r WHERE q.vec_id % 20 = 0
), o AS (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id, xr) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM o WHERE rank <= 20
"""


def op11_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = lm.held_out(F.col("doc_id"))
    return lm.score(docs.select("doc_id", held.alias("held_out"), "text"), lm.fit(docs, ~held), ["doc_id", "held_out"])


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=50)


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
), k AS (SELECT count(*) AS all_docs, sum(len(w))::BIGINT AS all_terms FROM d WHERE len(w) > 0),
e AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM e WHERE t IN (SELECT t FROM b) GROUP BY r, doc_id, n, t),
w AS (SELECT t, floor(1000 * ln((2 * any_value(all_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, k GROUP BY t),
s AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * all_docs) // all_terms))))::BIGINT AS score
  FROM b JOIN p USING (t) JOIN w USING (t), k GROUP BY item_id, r, doc_id
), o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= 50
"""


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(read(spark, sf_dir, "documents"), seed=42, percent=50, spm_percent=80)
    digests = [F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h FROM documents),
x AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), y AS (
  SELECT doc_id, t, len(w) AS n, w, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM x
), z AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(w[1:a], ''), '') AS p, coalesce(array_to_string(w[a + 1:b], ''), '') AS m, coalesce(array_to_string(w[b + 1:], ''), '') AS s FROM y
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM z
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_simhash": op1_simhash, "op2_mixing": op2_mixing, "op3_chat": op3_chat, "op4_linededup": op4_linededup, "op5_sharding": op5_sharding, "op6_pii": op6_pii, "op7_warc": op7_warc, "op8_langid": op8_langid, "op9_decontamination": op9_decontamination, "op10_topk": op10_topk, "op11_lm": op11_lm, "op12_lexical": op12_lexical, "op13_fim": op13_fim}


def oracle_sql() -> dict[str, str]:
    return {"op4_linededup": OP4_SQL, "op7_warc": OP7_SQL, "op9_decontamination": OP9_SQL, "op10_topk": OP10_SQL, "op12_lexical": OP12_SQL, "op13_fim": OP13_SQL}
