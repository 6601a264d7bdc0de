"""Job states with expiry: the stream against its batch twin and a plain fold, with late, repeated and expired events."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from paperloom.streaming import jobs as stream
from paperloom.streaming import progress

T0 = datetime(2024, 1, 1)
SCHEMA = "job_id string, event_id long, ts timestamp, kind string, pages int, page int, document_type int, page_progress int, qc int"


def event(job, i, minute, kind, pages=None, page=None, kind_of=None, done=None, qc=None):
    return job, i, T0 + timedelta(minutes=minute), kind, pages, page, kind_of, done, qc


def plain(rows, ttl=120):
    """status, pages, progress, entries and minute of the last event by job."""
    jobs = {}
    for job, _, ts, kind, pages, page, t, done, qc in sorted(rows, key=lambda r: (r[2], r[1])):
        now = (ts - T0).total_seconds() / 60
        at = jobs.get(job)
        if kind == "other":
            continue
        if at and now - at["last"] > ttl:
            at["dead"] = True
        if kind == "split":
            jobs[job] = {"pages": pages, "entries": {}, "status": "processing", "last": now, "dead": False}
        elif at and not at["dead"]:
            if kind in ("progress", "completed") and not 0 <= page < at["pages"]:
                continue
            if kind == "completed":
                at["entries"][page] = {"t": t, "p": None, "qc": qc}
            elif kind == "progress" and page in at["entries"]:
                at["entries"][page]["p"] = done
            elif kind == "progress":
                at["entries"][page] = {"t": t or None, "p": done, "qc": -1}
            at["status"], at["last"] = {"final": "ready", "exception": "exception"}.get(kind, "processing"), now
    return {
        j: (a["status"], a["pages"], round(sum((e["p"] or 0) if e["qc"] == -1 else 100 for e in a["entries"].values()) / a["pages"]), [(p, e["t"], e["p"], e["qc"]) for p, e in sorted(a["entries"].items())], a["last"])
        for j, a in jobs.items()
    }


def shown(row):
    return row.status, row.pages, row.full_progress, [tuple(e) for e in row.entries], (row.last_ms / 1000 - T0.timestamp()) / 60


def random_events():
    rng, out = random.Random(6), []
    for i in range(1500):
        kind = rng.choice(["split", "progress", "progress", "progress", "completed", "completed", "final", "exception", "other"])
        out.append(event(f"j{rng.randint(0, 9)}", i, i * 4 + rng.randint(0, 30), kind, rng.randint(1, 5) if kind == "split" else None, rng.randint(0, 4), rng.choice([None, 0, 46, 100]), rng.randint(0, 100), rng.randint(0, 4)))
    return out


def test_batch_twin(spark):
    rows = random_events()
    df = spark.createDataFrame([*rows, (None, 1, T0, "split", 3, None, None, None, None), ("x", 2, None, "split", 3, None, None, None, None)], SCHEMA)
    got = {r.job_id: shown(r) for r in progress.fold_events(df.withColumn("split", F.lit(1)).withColumn("total", F.lit("clash"))).collect()}
    want = plain(rows)
    assert got == want and len(got) == 10


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def run(spark, tmp_path, batches):
    """State after each batch: the newest rows and how many jobs are held."""
    source, seen = tmp_path / "in", []
    for rows in batches:
        write(spark, source, rows)
        q = stream.write_status(progress.job_progress(spark.readStream.schema(SCHEMA).parquet(str(source))), str(tmp_path / "out"), str(tmp_path / "state"))
        q.awaitTermination()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        newest = stream.newest(spark.read.parquet(str(tmp_path / "out")), ["job_id"]).collect()
        seen.append(({r.job_id: r for r in newest}, held[-1]))
    return seen


def test_stream_equals_fold(spark, tmp_path):
    """In whatever micro-batches the events come, those alive at the end are the same."""
    rows = sorted(random_events(), key=lambda r: (r[2], r[1]))
    last = max(r[2] for r in rows)
    want = {j: v for j, v in plain(rows).items() if v[4] + 120 >= (last - T0).total_seconds() / 60}
    for k, cuts in enumerate(([1500], [400, 401, 1100, 1500])):
        seen = run(spark, tmp_path / str(k), [rows[a:b] for a, b in zip([0, *cuts], cuts)])
        newest = {j: r for j, r in seen[-1][0].items() if not r.expired and r.last_ms + 7_200_000 >= last.timestamp() * 1000}
        assert {j: shown(r) for j, r in newest.items()} == want and want


def test_expiry_late_and_repeated(spark, tmp_path):
    first = [event("a", 1, 0, "split", 2), event("a", 2, 1, "progress", page=0, done=30), event("a", 3, 2, "progress", page=0, kind_of=46, done=40), event("b", 4, 0, "split", 1), event("b", 5, 3, "completed", page=0, kind_of=100, qc=0)]
    later = [event("c", 6, 200, "split", 4), event("a", 7, 201, "progress", page=1, done=10)]  # a has ended: no job any more
    late = [event("b", 8, 5, "progress", page=0, done=50), event("c", 9, 202, "progress", page=0, kind_of=0, done=70), event("c", 9, 202, "progress", page=0, kind_of=0, done=70)]
    seen = run(spark, tmp_path, [first, later, late])
    assert shown(seen[0][0]["a"])[:4] == ("processing", 2, 20, [(0, None, 40, -1)]) and shown(seen[0][0]["b"])[2] == 100 and seen[0][1] == 2
    assert seen[1][0]["a"].expired and seen[1][0]["a"].entries is None and seen[1][0]["b"].expired and seen[1][1] == 1  # the state shrinks
    assert seen[2][0]["b"].expired and shown(seen[2][0]["c"])[:4] == ("processing", 4, 18, [(0, None, 70, -1)]) and seen[2][1] == 1
