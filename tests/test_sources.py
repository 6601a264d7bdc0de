"""Sources and streams over small files."""

import time
from datetime import datetime

from pyspark.sql import functions as F

from paperloom.sources import files, recognize
from paperloom.streaming import jobs as stream


def test_gazetteer_of_several_splits(spark, tmp_path):
    """Ids are the lines' places, without gaps, however many splits the file has."""
    path = tmp_path / "names.csv"
    path.write_text("".join(f"name{i},MALE,{100_000 - i}\n" for i in range(50_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        g = files.read_gazetteer(spark, str(path))
        assert g.rdd.getNumPartitions() > 3
        assert g.where(F.concat(F.lit("name"), F.col("id").cast("string")) != F.col("word")).count() == 0 and g.count() == 50_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_templates(spark, tmp_path):
    (tmp_path / "front.json").write_text('{"a": [1,\n 2]}')
    (tmp_path / "bad.json").write_text('{"a": ')
    got = {r.name: r.template for r in files.read_templates(spark, str(tmp_path)).collect()}
    assert got == {"front": '{"a": [1,\n 2]}', "bad": None}


def test_files_and_rejects(spark, tmp_path):
    for name in ("a.PDF", "b.png", "c.txt", "d"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r.file_name for r in files.read_files(spark, str(tmp_path)).collect()) == ["a.PDF", "b.png"]


def test_late_events_and_updates(spark, tmp_path):
    """Batches update windows; an event later than the watermark is left out; a stream read again from its state gives nothing twice."""
    rows = [[(1, 10, "ready"), (2, 14, "ready")], [(3, 10, "ready"), (4, 14, "ready")], [(5, 15, "waiting")]]
    for i, part in enumerate(rows):
        df = spark.createDataFrame([(k, datetime(2024, 1, 1, h, 5), s) for k, h, s in part], "event_id long, ts timestamp, status string")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"n{i}"))
    def read():
        return spark.readStream.schema("event_id long, ts timestamp, status string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))

    out = stream.run_available(stream.tumbling_status(read()), ["window", "status"])
    got = {(r.window.start.hour, r.status): r.n for r in out.collect()}
    assert got[14, "ready"] == 2 and got[15, "waiting"] == 1 and got[10, "ready"] in (1, 2)
    path, state = str(tmp_path / "rows"), str(tmp_path / "state")
    for _ in range(2):
        stream.write_status(stream.latest_state(read().withColumn("job_id", F.lit("j"))), path, state).awaitTermination()
    newest = stream.newest(spark.read.parquet(path), ["job_id"]).collect()
    assert len(newest) == 1 and newest[0].status == "waiting"


class Slow(recognize.FixtureRecognizer):
    """Takes too long where the page says so."""

    def split(self, file, name):
        if b"slow-file" in file:
            time.sleep(3)
        return super().split(file, name)

    def barcodes(self, page, angle):
        if b"slow-codes" in page:
            time.sleep(3)
        if b"bad" in page:
            raise ValueError("bad page")
        return super().barcodes(page, angle)

    def written(self, pieces):
        if b"slow" in pieces:
            time.sleep(3)
        if b"bad" in pieces:
            raise ValueError("bad piece")
        return super().written(pieces)


def test_deadlines(spark):
    """A call without an answer in time gives null and is named; other calls, pages and files of the same task go on."""
    rows = [("a", "x.pdf", bytearray(b"one #5\x0cslow-codes #6\x0cbad\x0cfour #7")), ("b", "y.png", bytearray(b"slow-file")), ("c", "z.png", bytearray(b"last #8"))]
    df = spark.createDataFrame(rows, "job_id string, file_name string, file binary").coalesce(1)
    got = {(r.job_id, r.page_num): r for r in recognize.recognize(df, Slow, 0.7).collect()}
    assert sorted(got) == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0), ("c", 0)]
    assert [got["a", n].barcodes for n in range(4)] == [["5"], None, None, ["7"]] and got["c", 0].barcodes == ["8"]
    assert got["a", 1].late == ["barcodes"] and got["a", 1].text == "slow-codes #6" and len(got["a", 1].logits) == 5 and got["a", 1].qc is None
    assert got["a", 2].exception == "ValueError: bad page" and got["a", 0].late is None
    assert got["b", 0].qc == 4 and got["b", 0].exception.startswith("TimeoutError")
    assert recognize.recognize(df.limit(0), Slow, 0.7).count() == 0


def test_handwriting_deadline(spark):
    rows = [(1, [b"a1", b"b"]), (2, [b"slow", b"2"]), (3, None), (4, []), (5, [b"bad", b"1", b"2"]), (6, [b"7", b"8"])]
    df = spark.createDataFrame(rows, "k int, pieces array<binary>").coalesce(1)
    got = {r.k: r.answers for r in recognize.written(df, "k", Slow, 0.7).collect()}
    assert got == {1: [True, False], 2: [False], 3: None, 4: [], 5: [False], 6: [True, True]}
