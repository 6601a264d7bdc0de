"""Job states and status counts over a stream of job events."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

# The states of a job, in the order in which it passes through them.
STATES = ("in pool", "waiting", "processing", "ready", "exception")


def status_of(event_type: Column) -> Column:
    """The job state that an event stands for."""
    return F.when(event_type == "signup", "in pool").when(event_type == "view", "waiting").when(event_type == "click", "processing").when(event_type == "purchase", "ready").when(event_type == "error", "exception")


def latest_state(events: DataFrame) -> DataFrame:
    """The last status of each job: one row of state per job."""
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("ts"))


def tumbling_status(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by status and window; events that come later than `late` after the newest are left out, and a window's state ends
    with the watermark (in update and append mode)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "status").agg(F.count("*").alias("n"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; in local mode, where that is unset, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="paperloom-")
    return f"{root.rstrip('/')}/paperloom-streams/{uuid.uuid4().hex}"


def write_status(df: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Write the rows that each micro-batch adds or changes below path, in a folder of the batch's number, and start the query on
    what the stream has now. A batch that is tried again replaces its own folder, so nothing stands twice."""
    put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")
    return df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(updates: DataFrame, key: list[str]) -> DataFrame:
    """The last row of each key in a table of updates (column batch)."""
    rest = [c for c in updates.columns if c not in (*key, "batch")]
    return updates.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(*key, "s.*")


def run_available(df: DataFrame, key: list[str], mode: str = "update") -> DataFrame:
    """All that a stream has now, as a table of the newest row of each key. State and updates lie in files below the shared
    folder; nothing is held by the driver."""
    spark, root = df.sparkSession, shared_folder(df.sparkSession)
    write_status(df, f"{root}/rows", f"{root}/state", mode).awaitTermination()
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/rows")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], df.schema)
    return newest(spark.read.schema(df.schema.add("batch", "long")).parquet(f"{root}/rows"), key)
