"""Page types from barcodes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions.checks import i25_body, octal_payload
from paperloom.operators.rules import RULES, type_table
from paperloom.sources.recognize import Recognizer
from paperloom.staging import stage


def parse(barcodes: DataFrame) -> DataFrame:
    """barcodes (…, type, data) with payload, description and hard_readable: an interleaved 2-of-5 code of more than ten digits that doesn't parse."""
    # in steps, so that no part is computed twice
    b = barcodes.withColumn("_parts", F.split(i25_body(F.col("data")), "9", -1)).withColumn("payload", octal_payload(F.col("_parts"))).drop("_parts")
    # the table of types has a fixed number of rows
    t = F.broadcast(type_table(barcodes.sparkSession))
    b = b.join(t, F.col("payload.document_type") == F.col("doc_id"), "left")
    # a code that reads well but names no known type is not hard to read
    b = b.withColumn("hard_readable", F.col("payload").isNull() & F.col("data").rlike("^[0-9]+$"))
    return b.withColumn("payload", F.when(F.col("doc_id").isNotNull(), F.col("payload"))).drop("doc_id")


def first_valid(parsed: DataFrame, page: list[str], order: list[str]) -> DataFrame:
    """The first barcode of each page that parses; type 0 if none does."""
    n = F.row_number().over(W.partitionBy(*page).orderBy(F.col("payload").isNull(), *order))
    any_hard = F.max("hard_readable").over(W.partitionBy(*page))
    b = parsed.withColumn("n", n).withColumn("any_hard", any_hard).where("n = 1")
    return b.select(*page, F.coalesce("payload.document_type", F.lit(0).cast("long")).alias("document_type"), F.col("payload.page").alias("page"), "description", (F.col("payload").isNull() & F.col("any_hard")).alias("hard_readable"))


# Degrees by which a page is turned before it is read. All pages are tried at the first three, those that showed a
# code hard to read also at the others, in this order.
FAST = (0.0, 4.0, -4.0)
SWEEP = tuple(-round(-3.8 + 0.3 * k, 1) for k in range(26))
FOUND = "array<struct<type string, data string>>"


def read_at(pages: DataFrame, make: Callable[[], Recognizer], angle: float) -> DataFrame:
    """pages with the column found: what the recognizer reads at that angle; none where it fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = make()
        for pdf in batches:
            found = []
            for page in pdf.page:
                try:
                    found.append([{"type": t, "data": d} for t, d in r.barcodes(bytes(page), angle)])
                except Exception:
                    found.append([])
            yield pdf.assign(found=found)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
    return pages.mapInPandas(run, f"{schema}, found {FOUND}")


def search(pages: DataFrame, key: list[str], make: Callable[[], Recognizer]) -> DataFrame:
    """(key, document_type, page_number, description, attempts) of each of pages (key, page): its first barcode that parses, at the
    first angle at which one does; type 0 if none does. attempts: how often the recognizer was called for the page.

    A plan of rounds: each reads the pages that are still open at one more angle, so no page is read after it is resolved, and
    the sweep is over when no page is left. A round is a map without a shuffle. Null pages are read as empty. Null keys and repeated rows are pages of their own.
    """
    names = [f"k{i}" for i in range(len(key))]
    left = pages.select(*[F.col(k).alias(n) for k, n in zip(key, names)], F.coalesce("page", F.lit(b"")).alias("page"), F.lit(False).alias("hard"))
    known, out, angles = sorted({r[3] for r in RULES}), [], FAST + SWEEP
    for n, angle in enumerate(angles):
        r = read_at(left, make, angle)
        codes = F.filter("found", lambda b: (b["type"] == "I25") & (b["data"] != ""))
        r = r.withColumn("codes", F.transform(codes, lambda b: b["data"]))
        r = r.withColumn("parsed", F.transform("codes", lambda d: F.struct(octal_payload(F.split(i25_body(d), "9", -1)).alias("p"))))
        first = F.get(F.filter("parsed", lambda x: F.coalesce(x["p"]["document_type"].isin(known), F.lit(False))), F.lit(0))["p"]
        r = r.select(*names, "page", (F.col("hard") | F.exists("parsed", lambda x: x["p"].isNull())).alias("hard"), first.alias("first"))
        r = stage(r)
        over = F.col("first").isNotNull() | F.lit(n == len(angles) - 1) | (F.lit(n == len(FAST) - 1) & ~F.col("hard"))
        out.append(r.where(over).select(*names, "first", F.lit(n + 1).alias("attempts")))
        left = r.where(~over).drop("first")
        if n >= len(FAST) - 1 and left.isEmpty():
            break
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    t = F.broadcast(type_table(pages.sparkSession))  # a fixed number of rows
    found = found.join(t, F.col("first.document_type") == F.col("doc_id"), "left")
    return found.select(*[F.col(n).alias(k) for n, k in zip(names, key)], F.coalesce("first.document_type", F.lit(0).cast("long")).alias("document_type"), F.col("first.page").alias("page_number"), "description", "attempts")
