"""The store of results and page files: retried batches, expired keys, compaction, both reads."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paperloom.plans.pdf_inputs import document, gray, jpeg
from paperloom.sources import store
from paperloom.sources.pdf import split_pdf

T0 = datetime(2024, 1, 1)


def rows(spark, *found):
    return spark.createDataFrame([(k, p, T0 + timedelta(minutes=m)) for k, p, m in found], store.RESULT)


def shown(spark, path, minute, ttl=store.TTL):
    now = F.lit(T0 + timedelta(minutes=minute))
    return {r.key: r.payload for r in store.living(store.entries(spark, path), now, ttl).collect()}


def test_batches_expiry_and_compaction(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    assert shown(spark, path, 0) == {}
    store.put(rows(spark, ("a", "a0", 0), ("b", "b0", 0), (None, "no key", 0)), path, 0)
    store.put(rows(spark, ("a", "broken", 10)), path, 1)
    store.put(rows(spark, ("a", "a1", 10), ("c", "c1", 11), ("c", "c0", 9)), path, 1)  # tried again: replaces itself
    assert shown(spark, path, 60) == {"a": "a1", "b": "b0", "c": "c1"} and shown(spark, path, 120) == {"a": "a1", "b": "b0", "c": "c1"}
    assert shown(spark, path, 121) == {"a": "a1", "c": "c1"} and shown(spark, path, 200) == {}
    store.compact(spark, path, F.lit(T0 + timedelta(minutes=125)))
    assert shown(spark, path, 60) == {"a": "a1", "c": "c1"}  # b is gone from the files
    store.put(rows(spark, ("a", "a1", 10), ("c", "c1", 11), ("c", "c0", 9)), path, 1)  # tried again after compaction
    store.put(rows(spark, ("c", "c2", 130), ("d", "d2", 130)), path, 2)
    want = {"a": "a1", "c": "c2", "d": "d2"}
    assert shown(spark, path, 130) == want
    # a compaction that was broken off before its mark changes nothing and is done again
    (tmp_path / "store/generation=2/batch=-1").mkdir(parents=True)
    (tmp_path / "store/generation=2/batch=-1/part.parquet").write_bytes(b"half")
    assert shown(spark, path, 130) == want
    (tmp_path / "store/generation=2/batch=-1/part.parquet").unlink()
    store.compact(spark, path, F.lit(T0 + timedelta(minutes=130)))
    assert shown(spark, path, 130) == want
    assert sorted(p.name for p in (tmp_path / "store").iterdir() if p.name[0] != ".") == ["generation=1", "generation=2", "ready=1", "ready=2"]


def test_reads(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store.put(rows(spark, ("a", "x", 0), ("old", "y", -500)), path, 0)
    alive = store.living(store.entries(spark, path), F.lit(T0))
    asked = spark.createDataFrame([("a",), ("old",), ("",), (None,), ("other",), ("a",)], "key string")
    got = sorted(((r.key, r.code, r.payload, r.error) for r in store.get(asked, alive).collect()), key=str)
    none, missing = '{"status":"exception","description":"key not exists"}', '{"status":"exception","description":"key not specified"}'
    assert got == sorted([("a", 200, "x", None)] * 2 + [("old", 404, None, none), ("other", 404, None, none), ("", 400, None, missing), (None, 400, None, missing)], key=str)


@pytest.mark.parametrize("pages", [[[gray(400, 410, 7)], [jpeg(500, 600, b"\xff\xd8 x \xff\xd9")], [gray(401, 400, 9, predictor=True)]]])
def test_page_files(spark, tmp_path, pages):
    """A stored page is a PDF file whose image is the page's."""
    split = split_pdf(spark.createDataFrame([("j", "a.pdf", document(pages)), ("bad", "b.pdf", b"")], "job_id string, file_name string, file binary"))
    path = f"file://{tmp_path}/pages"
    store.put(store.page_files(split, F.concat_ws("-", "job_id", "page_num"), F.lit(T0)), path, 0)
    read = store.get(spark.createDataFrame([("j-0",), ("j-1",), ("j-2",), ("bad-0",)], "key string"), store.living(store.entries(spark, path, store.PAGE), F.lit(T0)))
    again = split_pdf(read.where("code = 200").select(F.col("key").alias("job_id"), F.lit("p.pdf").alias("file_name"), F.col("payload").alias("file")))
    image = lambda r: (r.format, r.width, r.height, len(r.image) if r.format == "png" else bytes(r.image))
    assert {r.job_id: image(r) for r in again.collect()} == {f"j-{r.page_num}": image(r) for r in split.where("image is not null").collect()}
    assert read.where("code = 404").count() == 1
