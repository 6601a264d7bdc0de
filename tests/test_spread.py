"""Queries that make much of each key are dealt to several tasks, though the keys' file is one."""

import pandas as pd
import pytest

from paperloom.plans import pages
from tests.conftest import SF


@pytest.mark.parametrize("name", ["red_frames", "pdf_split"])
def test_keys_of_one_file_are_dealt_out(spark, name):
    assert getattr(pages, name)(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_pages_are_drawn_and_read_in_small_batches(spark):
    """Many pages are neither drawn in one batch nor sent to a worker in one."""
    drawn = list(pages._framed_pages([pd.DataFrame({"c_custkey": range(3000)})]))
    assert sum(map(len, drawn)) == 3000 and max(len(b) * len(b.data.iloc[0]) for b in drawn) <= 8 << 20
    key, sizes = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(key)
    spark.conf.set(key, "256m")
    try:
        pages.red_frames(spark, SF)
        images = spark.range(600).coalesce(1).selectExpr("id", "repeat('x', 57600) AS data")
        sizes = [r.n for r in images.mapInPandas(lambda bs: (pd.DataFrame({"n": [len(b)]}) for b in bs), "n long").collect()]
    finally:
        spark.conf.set(key, before)
    assert sum(sizes) == 600 and max(sizes) * 57600 < 10 << 20
