"""Requests and their answers; one stream with several sinks."""

import json

from pyspark.sql import functions as F

from paperloom.sources import intake, store

SCHEMA = "request_id long, path string, http_method string, priority string, files array<struct<name string, content binary>>"
FILE = [("scan.PDF", b"x")]
GOLDEN = [
    (1, "/upload", "POST", None, FILE, 200, None), (2, "/simple_api/upload", "POST", "1", [("a.jpeg", b"y")], 200, None), (3, "/other", "POST", None, FILE, 404, None), (4, "/upload", "GET", None, None, 200, None),
    (5, "/upload", "PUT", None, FILE, 405, None), (6, "/upload", "POST", "x", FILE, 500, None), (7, "/upload", "POST", None, [], 500, None), (8, "/upload", "POST", None, None, 500, None),
    (9, "/upload", "POST", None, FILE * 2, 400, intake.TOO_MANY), (10, "/upload", "POST", "0", [("", b"")], 400, intake.NO_FILE), (11, "/upload", "POST", None, [("a.exe", b"")], 400, intake.WRONG_KIND),
    (12, "/simple_api/passport_upload", "POST", "-3", [("файл.png", b"z")], 200, None), (13, "/upload", "POST", None, [("файл", b"")], 400, intake.WRONG_KIND), (14, "/upload", "POST", "", [("c:\\dir\\my scan.jpg", None)], 200, None),
    (15, "/upload", None, None, FILE, 405, None), (16, None, "POST", None, FILE, 404, None), (17, "/upload", "POST", " 2 ", [("pdf", b"")], 200, None),
]


def check(rows):
    got = {r.request_id: r for r in rows}
    assert len(got) == len(GOLDEN)
    for i, path, method, priority, files, code, message in GOLDEN:
        r = got[i]
        assert r.code == code and (json.loads(r.body)["description"] if code == 400 else None) == message, i
        taken = code == 200 and method == "POST"
        assert (r.job_id is not None) == taken and r.method == intake.ROUTES.get(path)
        if taken:
            assert json.loads(r.body) == {"id": r.job_id} and r.high == (int(priority or 0) > 0) and r.file_name.startswith(r.job_id + ".") and bytes(r.file) == (files[0][1] or b"")
    assert got[1].file_name.endswith("..PDF") and got[2].file_name.endswith(".jpeg") and got[14].file_name.endswith("..jpg") and len({got[i].job_id for i in (1, 2, 12, 14, 17)}) == 5


def test_golden_requests(spark):
    df = spark.createDataFrame([g[:5] for g in GOLDEN], SCHEMA).withColumn("job", F.lit("clash")).withColumn("one", F.lit(1))
    check(intake.answer(df).collect())


def test_stream_with_several_sinks(spark, tmp_path):
    source, out = tmp_path / "in", f"file://{tmp_path}/out"
    for part in (GOLDEN[:8], GOLDEN[8:]):
        spark.createDataFrame([g[:5] for g in part], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        intake.write_answers(intake.answer(spark.readStream.schema(SCHEMA).parquet(str(source))), out, str(tmp_path / "state")).awaitTermination()
    replies = {r.request_id: r.code for r in spark.read.parquet(f"{out}/replies").collect()}
    assert replies == {g[0]: g[5] for g in GOLDEN}
    jobs = spark.read.parquet(f"{out}/jobs").collect()
    status = {r.key: r.payload for r in store.entries(spark, f"{out}/status").collect()}
    assert len(jobs) == 5 and status == {r.job_id: '{"status":"in pool"}' for r in jobs}
