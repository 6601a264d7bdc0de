"""A store of results and page files by key: files below a shared folder, written by numbered batches, read by key, with expiry.

A batch that is tried again replaces its own folder. The newest row of a key counts, until `ttl` seconds after it was written.
Compaction writes what is alive into a new generation and then marks it ready; readers take the newest ready one, and the
one before stays until the next compaction, so a reader that has begun goes on. There is one writer at a time, as in foreachBatch.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seconds that an entry lives.
TTL = 7200
RESULT = T.StructType([T.StructField("key", T.StringType()), T.StructField("payload", T.StringType()), T.StructField("ts", T.TimestampType())])
PAGE = T.StructType([T.StructField("key", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("ts", T.TimestampType())])


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _generations(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the ready generations, in order; 0 needs no mark."""
    fs, p = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return [0] + sorted(int(n[6:]) for n in names if n.startswith("ready=") and n != "ready=0")


def put(rows: DataFrame, path: str, batch: int) -> None:
    """Write rows (key, payload, ts) as a batch. Null keys are left out; of a key's rows all are kept, the newest counts."""
    now = _generations(rows.sparkSession, path)[-1]
    rows.where("key is not null and ts is not null").select("key", "payload", "ts").write.mode("overwrite").parquet(f"{path}/generation={now}/batch={batch}")


def entries(spark: SparkSession, path: str, schema: T.StructType = RESULT) -> DataFrame:
    """The newest row of each key: by time, then batch, then payload."""
    folder = f"{path}/generation={_generations(spark, path)[-1]}"
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(folder)
    return rows.groupBy("key").agg(F.max_by(F.struct("payload", "ts"), F.struct("ts", "batch", F.xxhash64("payload"))).alias("s")).select("key", "s.payload", "s.ts")


def living(rows: DataFrame, now: Column, ttl: int = TTL) -> DataFrame:
    """Rows whose time has not run out at the time now."""
    return rows.where(F.unix_micros("ts") + ttl * 1_000_000 >= F.unix_micros(now))


def compact(spark: SparkSession, path: str, now: Column, schema: T.StructType = RESULT, ttl: int = TTL) -> None:
    """One table of what is alive in the place of all batches. Broken off anywhere, it leaves a store that reads the same."""
    ready = _generations(spark, path)
    new = ready[-1] + 1
    living(entries(spark, path, schema), now, ttl).write.mode("overwrite").parquet(f"{path}/generation={new}/batch=-1")
    fs, mark = _fs(spark, f"{path}/ready={new}")
    fs.create(mark, True).close()
    for old in ready[:-1]:  # the one before the new one stays
        for name in (f"ready={old}", f"generation={old}"):
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)


def get(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """asked (key) with code and payload, or the error: 400 without a key, 404 for one that is unknown or whose time has run out, else 200."""
    r = rows.select(F.col("key").alias("r_key"), "payload")
    code = F.when(F.coalesce(F.col("key"), F.lit("")) == "", 400).when(F.col("r_key").isNull(), 404).otherwise(200)
    error = F.when(code == 400, "key not specified").when(code == 404, "key not exists")
    found = asked.select("key").join(r, F.col("key") == F.col("r_key"), "left")
    return found.select("key", code.alias("code"), F.when(code == 200, F.col("payload")).alias("payload"), F.when(error.isNotNull(), F.to_json(F.struct(F.lit("exception").alias("status"), error.alias("description")))).alias("error"))


def page_file(form: str, width: int, height: int, image: bytes) -> bytes:
    """A PDF file of one page that is the image: JPEG as it is, PNG (8-bit gray or RGB) by its own pixel data."""
    if form == "jpeg":
        coding, space, body = b"/Filter /DCTDecode", b"/DeviceRGB", image
    else:
        colors, at, parts = 3 if image[25] == 2 else 1, 8, []
        while at < len(image):
            size, kind = struct.unpack(">I4s", image[at : at + 8])
            parts += [image[at + 8 : at + 8 + size]] if kind == b"IDAT" else []
            at += size + 12
        body = zlib.compress(zlib.decompress(b"".join(parts)))
        coding = b"/Filter /FlateDecode /DecodeParms << /Predictor 15 /Colors %d /BitsPerComponent 8 /Columns %d >>" % (colors, width)
        space = b"/DeviceRGB" if colors == 3 else b"/DeviceGray"
    draw = b"q %d 0 0 %d 0 0 cm /Im0 Do Q" % (width, height)
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Contents 4 0 R /Resources << /XObject << /Im0 5 0 R >> >> >>" % (width, height),
        b"<< /Length %d >>\nstream\n%s\nendstream" % (len(draw), draw),
        b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /BitsPerComponent 8 /ColorSpace %s %s /Length %d >>\nstream\n%s\nendstream" % (width, height, space, coding, len(body), body),
    ]
    out, places = b"%PDF-1.4\n", []
    for n, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, o)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 6\n0000000000 65535 f \n" + table + b"trailer\n<< /Size 6 /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % len(out)


def page_files(pages: DataFrame, key: Column, ts: Column) -> DataFrame:
    """Rows (key, payload, ts) for put: the page files of pages (format, width, height, image); pages without an image have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [page_file(f, int(w), int(h), bytes(i)) for f, w, h, i in zip(b.format, b.width, b.height, b.image)]
            yield pd.DataFrame({"key": b["key"], "payload": made, "ts": b["ts"]})

    rows = pages.where("image is not null").select(key.cast("string").alias("key"), ts.alias("ts"), "format", "width", "height", "image")
    return rows.mapInPandas(run, PAGE)
