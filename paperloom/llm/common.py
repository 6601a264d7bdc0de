"""Helpers shared by the operators: written intermediate tables and row keys."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.staging import small_batches  # noqa: F401  the operators take it from here

#: Folders of staged tables that still exist, by the identity of their DataFrame.
_FOLDERS: dict[int, str] = {}
#: Spark's setting by which a query's shuffle files are removed at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A word is a maximal run of characters other than space and the five ASCII control blanks.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, where that is unset, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut, nothing is computed twice. Shuffle files go
    as soon as the table is written; else they stay until the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/paperloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)  # a plan of its own, made under the setting
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[id(out)] = path
    weakref.finalize(out, _FOLDERS.pop, id(out), None)
    return out


def drop_staged(*frames: DataFrame) -> None:
    """Delete the folders of staged tables that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        if folder := _FOLDERS.pop(id(df), None):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: Column) -> Column:
    """Number of words of a text as long; 0 for null."""
    lead = F.when(F.coalesce(text, F.lit("")).rlike(r"^[^\x20\x09-\x0D]"), 1).otherwise(0)
    # each word but one at the very start is preceded by a run of blanks
    return (lead + F.coalesce(F.regexp_count(text, F.lit(r"[\x20\x09-\x0D][^\x20\x09-\x0D]")), F.lit(0))).cast("long")


def row_key(id_col: Column, text: Column) -> list[Column]:
    """Columns that identify a document row by id and content; rows that agree on them are repeats of one another."""
    return [id_col.alias("k_id"), F.xxhash64(text).alias("k_text"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("k_crc")]


def row_hashes(df: DataFrame) -> list[Column]:
    """Columns r1 and r2, two hashes over all columns of df: rows that agree on both are equal throughout, but for a chance of 2^-128."""
    nested = ("array", "map", "struct", "variant")
    cols = [F.to_json(df[f.name], {"ignoreNullFields": "false"}) if f.dataType.simpleString().startswith(nested) else df[f.name] for f in df.schema.fields]
    nulls = F.concat(*[F.when(df[f.name].isNull(), "1").otherwise("0") for f in df.schema.fields])  # a hash skips nulls
    return [F.xxhash64(F.lit(k), nulls, *cols).alias(f"r{k}") for k in (1, 2)]


def same_key(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    """Null-safe equality on several columns."""
    cond = F.lit(True)
    for n in names:
        cond = cond & a[n].eqNullSafe(b[n])
    return cond
