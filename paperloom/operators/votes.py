"""Votes over repeated classifications and readings."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_of(views: list[Column]) -> Column:
    """Element-wise mean of arrays of one length."""
    total = views[0]
    for v in views[1:]:
        total = F.zip_with(total, v, lambda a, b: a + b)
    return F.transform(total, lambda x: x / len(views))


def argmax(logits: Column) -> Column:
    """0-based place of the largest value, the first of equals."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def rotation_vote(views: list[Column]) -> Column:
    """Orientation from the logits of four quarter turns: each turn's are shifted back into line, then averaged."""
    shifted = [F.concat(F.slice(v, (4 - i) % 4 + 1, 4), F.slice(v, 1, (4 - i) % 4)) if i else v for i, v in enumerate(views)]
    return argmax(mean_of(shifted))


def above(scores: Column, limit: float) -> Column:
    """True if the mean of an array is over the limit."""
    return F.coalesce(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores) > limit, F.lit(False))


# The mean scores above which a page is a text, and a piece of a page is written on.
TEXT_ABOVE, HAND_ABOVE = 0.3, 0.5


def is_text(scores: Column) -> Column:
    """The text gate; no answer counts as no."""
    return above(scores, TEXT_ABOVE)


def is_handwritten(scores: Column) -> Column:
    """The handwriting gate; no answer counts as no."""
    return above(scores, HAND_ABOVE)


def angle(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """The median of the angles whose rounding is the most frequent (the smallest of equals), for each key."""
    r = df.withColumn("r", F.bround(value).cast("int"))
    best = r.groupBy(*key, "r").agg(F.count("*").alias("n"), F.median(value).alias("m"))
    return best.groupBy(*key).agg(F.max_by(F.struct("r", "m"), F.struct("n", -F.col("r"))).alias("b")).select(*key, F.col("b.r").alias("angle"), F.col("b.m").alias("median"))


def frequent10(t: str | None) -> list[str]:
    """The ten-character windows at places i * 10 + j (i < 7, j < 10) that occur more than twice, by their first place in order of j, then i."""
    seen = Counter(t[i * 10 + j : i * 10 + j + 10] for j in range(10) for i in range(7)) if t else {}
    return [w for w, n in seen.items() if n > 2 and len(w) == 10]


def substring_vote(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """key and vote: of the windows that occur more than twice, the one whose eight repetitions are nearest the text by
    edit distance, the first seen of equals; empty if there is none. Each row by itself, without a shuffle."""

    @F.pandas_udf("array<string>")
    def often(texts: pd.Series) -> pd.Series:
        return texts.map(frequent10)

    w = df.select(*key, F.col(text).alias("_t"), often(F.col(text)).alias("_w"))
    # the least place of equal distances is that of the window seen first
    far = F.transform("_w", lambda x, i: F.struct(F.levenshtein(F.repeat(x, 8), F.col("_t")).alias("d"), i.alias("i"), x.alias("w")))
    return w.select(*key, F.coalesce(F.array_min(far)["w"], F.lit("")).alias("vote"))
