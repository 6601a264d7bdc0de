"""Written intermediate tables."""

import glob

from pyspark.sql import functions as F

from paperloom.llm import common


def test_shuffle_files_go_with_the_write(spark):
    """After several staged tables no shuffle file of theirs is left, whether or not the driver collects garbage."""
    folders = [d.getAbsolutePath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for f in glob.glob(f"{d}/**/shuffle_*", recursive=True)}
    before, kept = files(), []
    for k in range(3):
        kept.append(spark.range(5000).groupBy((F.col("id") % (2000 + k)).alias("k")).agg(F.count("*").alias("n")))
        kept.append(common.stage(kept[-1], "counts"))
    assert not files() - before
    assert [kept[k].count() for k in (1, 3, 5)] == [2000, 2001, 2002]
