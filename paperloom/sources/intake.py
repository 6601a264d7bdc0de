"""Requests as they come in: routes, the rules for files, priorities, and what is answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from paperloom.functions.text import supported_file
from paperloom.sources import store

# Paths of the routes and the names of their methods.
ROUTES = {
    "/upload": "upload", "/simple_api/upload": "simple_upload", "/simple_api/passport_upload": "passport_upload", "/simple_api/driving_license_upload": "driving_license_upload",
    "/simple_api/passp_and_dlic_upload": "passp_and_dlic_upload", "/simple_api/barcodes_only_upload": "barcodes_only_upload",
}
# Messages.
TOO_MANY, NO_FILE, WRONG_KIND = "Not support more than one file for now", "file not exists", "file is not a .pdf .png .jpg .jpeg file"


def stored_name(name: Column, job_id: Column) -> Column:
    """The name under which a file is kept: the job's, and the last four characters of the file's own name, of which plain ASCII counts."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"\s+", "_"), "[^A-Za-z0-9_.-]", "")
    plain = F.regexp_replace(plain, r"^[._]+|[._]+$", "")
    return F.concat(job_id, F.lit("."), F.right(plain, F.lit(4)))


def answer(requests: DataFrame) -> DataFrame:
    """requests (request_id, path, http_method, priority, files: array of name and content) with job_id, method, code, body, high,
    file_name and file. The last three are null unless the request is taken, which is code 200 with a job_id in its body.

    404 for another path, 405 for another HTTP method; a GET is answered by the form. 500 for a priority that is no number or a
    POST without files, 400 for several files, one without a name or of another kind. Null files are none. Names are told
    apart by their ends only, without case. Rows are answered each by itself, in a batch or a stream.
    """
    r = requests.select("request_id", "path", "http_method", F.trim("priority").alias("asked"), F.coalesce("files", F.array().cast(requests.schema["files"].dataType)).alias("files"))
    job = F.md5(F.concat(F.lit("job "), F.col("request_id").cast("string")).cast("binary"))
    route = F.coalesce(*[F.when(F.col("path") == k, v) for k, v in ROUTES.items()])
    r = r.withColumns({"job": job, "method": route, "one": F.get("files", F.lit(0))})
    name = F.coalesce(F.col("one.name"), F.lit(""))
    r = r.withColumn("stored", stored_name(name, F.col("job")))
    refused = (
        F.when(F.size("files") > 1, TOO_MANY).when(name == "", NO_FILE).when(~F.coalesce(supported_file(F.col("stored")), F.lit(False)), WRONG_KIND)
    )
    broken = (F.coalesce("asked", F.lit("")) != "") & F.col("asked").try_cast("long").isNull() | (F.size("files") == 0)
    code = (
        F.when(F.col("method").isNull(), 404).when(F.col("http_method") == "GET", 200).when(F.coalesce(F.col("http_method") != "POST", F.lit(True)), 405)
        .when(broken, 500).when(refused.isNotNull(), 400).otherwise(200)
    )
    taken = (code == 200) & (F.col("http_method") == "POST")
    error = F.when(code == 400, F.to_json(F.struct(F.lit("exception").alias("status"), refused.alias("description"))))
    body = F.when(taken, F.to_json(F.struct(F.col("job").alias("id")))).otherwise(error)
    own = lambda c: F.when(taken, c)
    return r.select(
        "request_id", own(F.col("job")).alias("job_id"), "method", code.alias("code"), body.alias("body"), own(F.coalesce(F.col("asked").try_cast("long") > 0, F.lit(False))).alias("high"),
        own(F.col("stored")).alias("file_name"), own(F.coalesce(F.col("one.content"), F.lit(b""))).alias("file"),
    )


def write_answers(answers: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """One stream into several tables below path: jobs to do, replies, and for each job its first status in the store. A
    micro-batch that is tried again replaces what it wrote."""

    def put(batch: DataFrame, n: int) -> None:
        batch.persist()
        try:
            taken = batch.where("job_id is not null")
            taken.select("job_id", "method", "high", "file_name", "file").write.mode("overwrite").parquet(f"{path}/jobs/batch={n}")
            batch.select("request_id", "code", "body").write.mode("overwrite").parquet(f"{path}/replies/batch={n}")
            status = F.to_json(F.struct(F.lit("in pool").alias("status")))
            store.put(taken.select(F.col("job_id").alias("key"), status.alias("payload"), F.current_timestamp().alias("ts")), f"{path}/status", n)
        finally:
            batch.unpersist()

    return answers.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
