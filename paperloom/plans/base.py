"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(values: list[str] | tuple[str, ...]) -> str:
    """A list literal for SQL."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores: for keys of a few bytes each, a file of which is one task, from which much is made."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
