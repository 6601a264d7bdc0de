"""Progress of jobs as a stateful stream: one state for each job, folded event by event, that ends by itself.

Events of a job: split (its number of pages), progress (of a page, maybe with a type), completed (a page's result), final, exception.
A state lives for TTL after the job's last event; what comes later finds no job and is left out until a new split. State ends
by event time, so the stream forgets a job when the watermark has passed its end. `fold_events` gives the same for a table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds that a job's state outlives its last event.
TTL = 7200
#: Kinds of events and the status that the job has after each.
STATUS = {"split": "processing", "progress": "processing", "completed": "processing", "final": "ready", "exception": "exception"}
ENTRIES = "array<struct<page int, document_type int, page_progress int, qc int>>"
OUT = f"job_id string, status string, pages int, full_progress int, entries {ENTRIES}, last_ms long, expired boolean"


class Job:
    """What is known of a job: its status, number of pages, entries by page and the time of its last event in milliseconds."""

    def __init__(self, pages: int, last: int, status: str = "processing", entries: dict | None = None):
        self.pages, self.last, self.status, self.entries = pages, last, status, entries or {}

    def apply(self, kind: str, ms: int, page: int | None, document_type: int | None, page_progress: int | None, qc: int | None) -> None:
        if kind in ("progress", "completed"):
            if page is None or not 0 <= page < self.pages:
                return
            if kind == "completed":
                self.entries[page] = [document_type, None, qc]
            elif page in self.entries:  # a type that comes late is not taken
                self.entries[page][1] = page_progress
            else:
                self.entries[page] = [document_type or None, page_progress, -1]
        self.status, self.last = STATUS[kind], ms

    def progress(self) -> int:
        return round(sum((p or 0) if qc == -1 else 100 for _, p, qc in self.entries.values()) / self.pages) if self.pages else 0

    def row(self, job_id: str, expired: bool = False) -> tuple:
        if expired:
            return job_id, None, None, None, None, self.last, True
        return job_id, self.status, self.pages, self.progress(), [dict(zip(("page", "document_type", "page_progress", "qc"), (p, *e))) for p, e in sorted(self.entries.items())], self.last, False


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, ttl_ms: int) -> Iterator[pd.DataFrame]:
    job = held = None
    if state.exists:
        pages, last, status, entries = state.get
        job = held = Job(pages, last, status, {int(p): e for p, e in json.loads(entries).items()})
    if state.hasTimedOut:
        state.remove()
        rows = [held.row(key[0], expired=True)]
    else:
        events = pd.concat(list(batches)).sort_values(["ms", "event_id"])
        none = lambda x: None if pd.isna(x) else int(x)
        for e in events.itertuples(index=False):
            if job is not None and e.ms - job.last > ttl_ms:
                held, job = job, None
            if e.kind == "split":
                job = Job(none(e.pages) or 0, e.ms)
            elif job is not None and e.kind in STATUS:
                job.apply(e.kind, e.ms, none(e.page), none(e.document_type), none(e.page_progress), none(e.qc))
        if job is not None:
            state.update((job.pages, job.last, job.status, json.dumps(job.entries)))
            # a state whose end the watermark has passed ends with the next batch
            state.setTimeoutTimestamp(max(job.last + ttl_ms, state.getCurrentWatermarkMs() + 1))
            rows = [job.row(key[0])]
        elif held is not None:
            if state.exists:
                state.remove()
            rows = [held.row(key[0], expired=True)]
        else:
            return
    yield pd.DataFrame(rows, columns=["job_id", "status", "pages", "full_progress", "entries", "last_ms", "expired"])


def _events(events: DataFrame) -> DataFrame:
    cols = [F.col("job_id").cast("string").alias("job_id"), F.col("event_id").cast("long").alias("event_id"), "ts", "kind"]
    return events.select(*cols, *[F.col(c).cast("int").alias(c) for c in ("pages", "page", "document_type", "page_progress", "qc")], F.unix_millis("ts").alias("ms"))


def job_progress(events: DataFrame, late: str = "10 minutes", ttl: int = TTL) -> DataFrame:
    """The stream of events (job_id, event_id, ts, kind, pages, page, document_type, page_progress, qc) as updates of jobs: a
    row for each job that a micro-batch changes, and one with expired for each whose state ends.

    Events of a micro-batch are folded by time, then id; those later than `late` behind the newest are dropped. Events of unknown jobs,
    kinds or pages, and without a job or time, change nothing. State holds one row for each living job.
    """
    e = _events(events).where("job_id is not null and ts is not null").withWatermark("ts", late)
    return e.groupBy("job_id").applyInPandasWithState(lambda k, b, s: _fold(k, b, s, ttl * 1000), OUT, "pages int, last long, status string, entries string", "update", GroupStateTimeout.EventTimeTimeout)


def fold_events(events: DataFrame, ttl: int = TTL) -> DataFrame:
    """(job_id, status, pages, full_progress, entries, last_ms): the jobs of a table of events after all of these, in windows
    of one job. A job whose last event is followed by a later one of its own after the end of its state stays as it was then."""
    e = _events(events).where(F.col("job_id").isNotNull() & F.col("ts").isNotNull() & F.col("kind").isin(*STATUS))
    by_time = ("ms", "event_id")
    before = lambda *keys: W.partitionBy(*keys).orderBy(*by_time).rowsBetween(W.unboundedPreceding, 0)
    e = e.withColumn("split", F.sum((F.col("kind") == "split").cast("int")).over(before("job_id"))).where("split > 0")
    # pages of the split; events of other pages are none
    e = e.withColumn("total", F.first(F.when(F.col("kind") == "split", F.coalesce("pages", F.lit(0))), ignorenulls=True).over(before("job_id", "split")))
    e = e.where(~F.col("kind").isin("progress", "completed") | F.coalesce(F.col("page").between(0, F.col("total") - 1), F.lit(False)))
    gap = F.coalesce(F.col("ms") - F.lag("ms").over(W.partitionBy("job_id", "split").orderBy(*by_time)) > ttl * 1000, F.lit(False))
    e = e.withColumn("gap", gap).withColumn("dead", F.max("gap").over(before("job_id", "split"))).where(~F.col("dead"))
    e = e.withColumn("newest", F.max("split").over(W.partitionBy("job_id"))).where("split = newest")
    place = F.struct(*by_time)
    jobs = e.groupBy("job_id").agg(F.max_by("kind", place).alias("kind"), F.max("total").alias("pages"), F.max("ms").alias("last_ms"))
    p = e.where(F.col("kind").isin("progress", "completed")).withColumn("done", F.max(F.when(F.col("kind") == "completed", place)).over(W.partitionBy("job_id", "page")))
    own = p.groupBy("job_id", "page").agg(
        F.max(F.when(F.col("kind") == "completed", F.struct(*by_time, "document_type", "qc"))).alias("result"),
        F.min(F.when(F.col("kind") == "progress", F.struct(*by_time, "document_type"))).alias("first"),
        F.max(F.when((F.col("kind") == "progress") & (F.col("done").isNull() | (place > F.col("done"))), F.struct(*by_time, "page_progress"))).alias("last"),
    )
    known = F.when(F.col("result").isNotNull(), F.col("result.document_type")).when(F.col("first.document_type") != 0, F.col("first.document_type"))
    entry = F.struct("page", known.alias("document_type"), F.col("last.page_progress").alias("page_progress"), F.when(F.col("result").isNotNull(), F.col("result.qc")).otherwise(-1).alias("qc"))
    part = F.when(entry["qc"] == -1, F.coalesce(entry["page_progress"], F.lit(0))).otherwise(100)
    pages = own.groupBy(F.col("job_id").alias("p_job")).agg(F.array_sort(F.collect_list(entry)).cast(ENTRIES).alias("entries"), F.sum(part).alias("parts"))
    out = jobs.join(pages, jobs.job_id == pages.p_job, "left")
    return out.select("job_id", status_after(F.col("kind")).alias("status"), "pages", F.when(F.col("pages") > 0, F.bround(F.coalesce("parts", F.lit(0)) / F.col("pages"))).otherwise(0).cast("int").alias("full_progress"), F.coalesce("entries", F.array().cast(ENTRIES)).alias("entries"), "last_ms")


def status_after(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in STATUS.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def alive(jobs: DataFrame, now_ms: Column, ttl: int = TTL) -> DataFrame:
    """Jobs whose state has not ended at that time."""
    return jobs.where(F.col("last_ms") + ttl * 1000 >= now_ms)
