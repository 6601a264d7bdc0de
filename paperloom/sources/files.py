"""Files as they come in: extension filter, page images, splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions.text import supported_file


def read_files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """job_id, file_name, file of the supported files below a folder, as a batch or a stream."""
    r = spark.readStream if stream else spark.read
    f = r.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").load(path)
    return f.where(supported_file(F.col("path"))).select(F.md5(F.col("path").cast("binary")).alias("job_id"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("modificationTime").alias("enqueued_at"), F.col("content").alias("file"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded page images; what can't be decoded has qc 4 and a message."""
    i = spark.read.format("image").load(path).select("image.*")
    bad = F.col("height") < 0
    return i.withColumn("qc", F.when(bad, 4)).withColumn("exception", F.when(bad, "Bad image file."))


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """word, gender, popularity and id of a comma-separated file without quoting. Lines stand from most to least popular; id
    is the place in that order, dense over all splits of the file: counts of lines per split are added up, no line is moved."""
    raw = spark.read.csv(path, schema="word string, gender string, popularity double", quote="")
    # the high bits number the splits, in the file's order, the low ones the lines of a split
    at = raw.withColumn("at", F.monotonically_increasing_id()).withColumn("split", F.shiftright("at", 33))
    counts = at.groupBy("split").agg(F.count("*").alias("n"))
    starts = counts.select(F.col("split").alias("s"), (F.sum("n").over(W.orderBy("split")) - F.col("n")).alias("start"))
    return at.join(F.broadcast(starts), at.split == starts.s).select("word", "gender", "popularity", (F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("id"))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """name and template (JSON text, null if it isn't JSON) of the JSON files below a folder."""
    f = spark.read.format("text").option("wholetext", True).load(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("name"), "value")
    return f.select("name", F.when(F.try_parse_json("value").isNotNull(), F.col("value")).alias("template"))
