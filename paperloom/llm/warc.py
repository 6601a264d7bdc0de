"""Resolution of not-modified revisit records against the latest earlier full response of the same URL.

The as-of join needs no join of records with records: within a URL's captures in order of time, the last full response
before each revisit is carried forward. A URL may hold a large part of all captures, so captures are cut by URL and time
into slices of about as many captures: each (URL, slice) is one window group, and a window over the small table of every
slice's last response carries over from earlier slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.llm.common import stage

#: Headers that a not-modified response may update (RFC 9111, section 3.2); others stay those of the full response.
UPDATABLE = ("age", "cache-control", "date", "etag", "expires", "last-modified", "vary", "warning")
#: Captures in one slice, about.
SLICE = 20_000


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, https as http, no leading www. or m., no default port, fragment, tracking
    parameters (utm_*, ref, fbclid, gclid), empty query, closing slash or index page. Null for null."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.regexp_replace(F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), "^https$", "http")
    rest = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^(?:www\.|m\.)", ""), r":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/index\.html?$", "/"), "/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    args = F.array_sort(F.filter(F.split(query, "&"), lambda a: (a != "") & ~a.rlike(r"^(?:utm_[^=]*|ref|fbclid|gclid)(?:=|$)")))
    whole = F.concat(F.when(scheme == "", F.lit("http")).otherwise(scheme), F.lit("://"), host, path)
    return F.when(url.isNotNull(), F.when(F.size(args) > 0, F.concat(whole, F.lit("?"), F.array_join(args, "&"))).otherwise(whole))


def sliced(known: DataFrame, slice_rows: int) -> DataFrame:
    """known with the column slice, dealt by ranges of (canonical, ts) that hold about slice_rows captures each.

    The cuts are quantiles that Spark draws from the rows themselves: a heavy URL is cut where its captures are dense, and
    odd timestamps don't matter. Captures of one URL at one instant share a slice. Written, as slices are numbered once.
    """
    slices = max(1, -(-known.count() // slice_rows))
    return stage(known.repartitionByRange(slices, "canonical", "ts").withColumn("slice", F.spark_partition_id()), "captures")


def resolve(records: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """One row for each revisit of records (record_id, url, ts, kind, etag, last_modified, digest, headers map).

    kind is response or revisit. Result: record_id, canonical, ts, refers_to (record of the latest response of the same
    canonical URL with a smaller ts; ties go to the largest record_id), status, headers. status: resolved if a
    validator agrees (etag, else last_modified, else digest; the first that both sides have) or neither side has
    one in common; validator_mismatch; no_response if there is no earlier response or the URL or ts is null.
    headers: the response's, updated by the revisit's permitted ones; null unless resolved. Rows of other kinds, or
    responses without ts, take no part. Repeated rows are kept. URLs and headers of any length are read
    whole. Extra columns are ignored, whatever their names; an empty table gives an empty result.
    """
    r = records.select("record_id", canonical_url(F.col("url")).alias("canonical"), "ts", "kind", "etag", "last_modified", "digest", "headers").where(F.col("kind").isin("response", "revisit"))
    known = sliced(r.where("canonical is not null and ts is not null"), slice_rows)
    # the last response of each URL's slices, by time then record, carried over to later slices by a window on that small table
    last = known.groupBy("canonical", "slice").agg(F.max(F.when(F.col("kind") == "response", F.struct("ts", "record_id"))).alias("last"))
    earlier = W.partitionBy("canonical").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carry = last.select(F.col("canonical").alias("c_url"), F.col("slice").alias("c_slice"), F.max("last").over(earlier).alias("carried"))
    # earlier responses of the same slice; peers in time don't count
    keyed = known.withColumn("ord", F.dense_rank().over(W.partitionBy("canonical", "slice").orderBy("ts")))
    w = W.partitionBy("canonical", "slice").orderBy("ord").rangeBetween(W.unboundedPreceding, -1)
    here = keyed.withColumn("here", F.max(F.when(F.col("kind") == "response", F.struct("ts", "record_id"))).over(w)).where("kind = 'revisit'")
    joined = here.join(carry, (here.canonical == carry.c_url) & (here.slice == carry.c_slice), "left").withColumn("at", F.coalesce("here", "carried"))
    full = known.where("kind = 'response'").groupBy(F.col("canonical").alias("f_url"), F.col("ts").alias("f_ts"), F.col("record_id").alias("f_id")).agg(F.max_by(F.struct("etag", "last_modified", "digest", "headers"), F.struct("etag", "last_modified", "digest", F.array_sort(F.map_entries("headers")))).alias("f"))
    found = joined.join(full, (joined.canonical == full.f_url) & (joined["at"]["ts"] == full.f_ts) & joined["at"]["record_id"].eqNullSafe(full.f_id), "left")
    lost = r.where("kind = 'revisit' and (canonical is null or ts is null)")
    lost = lost.withColumn("f", F.lit(None).cast(full.schema["f"].dataType)).withColumn("f_id", F.lit(None).cast(full.schema["f_id"].dataType))
    return _judge(found).unionByName(_judge(lost))


def _judge(found: DataFrame) -> DataFrame:
    agree = F.lit(True)
    for v in ("digest", "last_modified", "etag"):  # the last put on is asked first
        agree = F.when(F.col(v).isNotNull() & F.col("f")[v].isNotNull(), F.col(v) == F.col("f")[v]).otherwise(agree)
    status = F.when(F.col("f").isNull(), "no_response").when(agree, "resolved").otherwise("validator_mismatch")
    empty = F.create_map().cast("map<string,string>")
    new = F.map_filter(F.coalesce("headers", empty), lambda k, v: F.lower(k).isin(*UPDATABLE))
    low = lambda m: F.transform_keys(m, lambda k, v: F.lower(k))
    old = F.map_filter(low(F.coalesce(F.col("f")["headers"], empty)), lambda k, v: ~F.array_contains(F.map_keys(low(new)), k))
    return found.select("record_id", "canonical", "ts", F.when(F.col("f").isNotNull(), F.col("f_id")).alias("refers_to"), status.alias("status"), F.when(status == "resolved", F.map_concat(old, low(new))).alias("headers"))
