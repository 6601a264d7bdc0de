"""Intermediate tables in the folder that driver and executors share, and the size of what workers get."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from paperloom.streaming.jobs import shared_folder


def stage(df: DataFrame) -> DataFrame:
    """df written as Parquet and read back: what made it runs once."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """From now on this session sends its Python workers no more than so many bytes of rows at once (a longer row by itself),
    if it sent more: both sides hold a whole batch, and texts are long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    digits, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", spark.conf.get(key).lower()).groups()
    if int(digits) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(unit[:1], 1) > most:
        spark.conf.set(key, str(most))
