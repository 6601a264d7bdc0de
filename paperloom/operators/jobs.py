"""Jobs and their pages: continuation, progress, state, queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.operators.rules import CONTINUED


def mark_continuation(pages: DataFrame, job: str = "job_id", order: str = "page_num") -> DataFrame:
    """pages (job, order, document_type, qc, description) with continuation pages marked.

    A page that was taken for an identity document but read badly continues the last page of another kind, if that
    kind has further pages (and not yet all of them). One shuffle by job; a job's pages are one window group.
    """
    kind, bad = F.col("document_type"), F.col("document_type").isin(100, 130, 140) & F.col("qc").isin(3, 4)
    anchor = (kind.isNotNull() & ~F.coalesce(bad, F.lit(False))).cast("int")
    by = W.partitionBy(job).orderBy(order)
    p = pages.withColumn("_grp", F.sum(anchor).over(by.rowsBetween(W.unboundedPreceding, 0)))
    in_grp = W.partitionBy(job, "_grp").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    p = p.withColumn("_dt0", F.first(F.when(anchor == 1, kind), ignorenulls=True).over(in_grp)).withColumn("_k", F.sum(F.coalesce(bad, F.lit(False)).cast("int")).over(in_grp))
    most = F.create_map(*[F.lit(x) for kv in CONTINUED.items() for x in kv])
    room = F.try_element_at(most, F.col("_dt0").cast("int"))
    cont = F.coalesce(bad & (F.col("_grp") > 0) & ((room == 0) | (F.col("_k") < room)), F.lit(False))
    p = p.withColumn("_c", cont)
    return (
        p.withColumn("document_type", F.when(F.col("_c"), F.col("_dt0")).otherwise(kind)).withColumn("description", F.when(F.col("_c"), F.lit("second page")).otherwise(F.col("description")))
        .withColumn("qc", F.when(F.col("_c"), F.lit(0)).otherwise(F.col("qc"))).drop("_grp", "_dt0", "_k", "_c")
    )


def first_orientation(pages: DataFrame, job: str = "job_id", order: str = "page_num") -> DataFrame:
    """The first known text orientation of each job, in page order."""
    return pages.groupBy(job).agg(F.min_by("orientation", F.when(F.col("orientation").isNotNull(), F.col(order))).alias("orientation"))


def progress(pages: DataFrame, job: str = "job_id") -> DataFrame:
    """Percent done of each job: finished pages count whole, pages in work (qc -1) by page_progress. Half-even rounding."""
    done = F.when(F.col("qc") == -1, F.col("page_progress") / 100.0).when(F.col("qc").isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))
    return pages.groupBy(job).agg(F.bround(F.sum(done) * 100 / F.count("*")).cast("int").alias("full_progress"))


def latest(statuses: DataFrame, key: str, ts: str, *more: str) -> DataFrame:
    """The last row of each key by time, then by the other columns."""
    cols = [c for c in statuses.columns if c != key]
    return statuses.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(ts, *more)).alias("s")).select(key, "s.*")


def queue_positions(jobs: DataFrame, id_col: str) -> DataFrame:
    """jobs with pos, their place in the whole queue. Places are counted within an hour of one queue; what the hours before
    hold comes from a table of one row for each hour, so no task sorts the queue."""
    slot = F.struct((F.col("priority") > 0).alias("high"), F.date_trunc("hour", "enqueued_at").alias("hour"))
    j = jobs.withColumn("_slot", slot)
    counts = j.groupBy("_slot").agg(F.count("*").alias("n"))
    starts = counts.select(F.col("_slot").alias("_s"), (F.sum("n").over(W.orderBy(F.desc("_slot")).rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("_start"))
    within = F.row_number().over(W.partitionBy("_slot").orderBy(F.desc("enqueued_at"), F.desc(id_col)))
    return j.withColumn("_n", within).join(starts, F.col("_slot") == F.col("_s")).withColumn("pos", F.col("_start") + F.col("_n")).drop("_slot", "_s", "_start", "_n")


def expired(enqueued: Column, now: Column, seconds: int = 700) -> Column:
    """True for jobs that waited longer than a job may."""
    return (now.cast("timestamp").cast("double") - enqueued.cast("timestamp").cast("double")) > seconds


def verdict(pages: DataFrame, job: str = "job_id") -> DataFrame:
    """good or bad for each job: bad if any page's fields were read poorly or not at all."""
    return pages.groupBy(job).agg(F.when(F.bool_or(F.coalesce(F.col("qc").isin(2, 3), F.lit(False))), "bad").otherwise("good").alias("verdict"))
