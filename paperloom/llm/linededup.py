"""Dedup of multi-line passages by content-defined line chunks, in DataFrame functions only.

A hash rolls over each two neighbouring lines. Where such a pair of lines stands nowhere else, no repeated chunk can span it, so
chunks always end there; within a run of repeated pairs, a chunk ends before a line at which the rolling hash, over line
hashes, is 0 modulo `divisor`. So boundaries depend on the lines around them alone, wherever a passage stands, and chunks
don't overlap. A chunk has two lines or more; a repeated line by itself is one only if it is long. Chunks are compared byte for byte;
of equal ones all but the first go, so each chunk's text stays where it first stands, whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.llm.common import drop_staged, row_key, stage, word_count

#: One in so many lines of a long run begins a chunk, about.
DIVISOR = 4
#: Words from which a single line is a passage.
LONG = 50
#: Base of the rolling hash.
BASE = 31
KEY = ("k_id", "k_text", "k_crc")


def _digits(two: Column) -> Column:
    """The value of two hexadecimal digits as a long."""
    one = lambda at: F.instr(F.lit("0123456789abcdef"), F.substring(two, at, 1)) - 1
    return (one(1) * 16 + one(2)).cast("long")


def _plain(name: str) -> Column:
    """The column as an expression. Of a bare column that is exploded Spark infers a filter on its size, which it
    pushes below the projections, where lambdas then hold whole expressions and compute them for each element."""
    return F.when(F.col(name).isNotNull(), F.col(name))


def marks(docs: DataFrame, id_col: str, text: str, divisor: int, long: int) -> DataFrame:
    """(k_id, k_text, k_crc, pair, i, h, cut): each pair of neighbouring lines and each long line of each text by the place i
    of its first line: its hash, and whether the rolling hash says that a chunk begins there."""
    df = docs.where(F.col(text).isNotNull()).select(*row_key(F.col(id_col), F.col(text)), F.split(F.col(text), "\n", -1).alias("lines"))
    df = df.withColumn("hs", F.transform("lines", lambda x: F.xxhash64(x))).withColumn("ds", F.transform("lines", lambda x: _digits(F.substring(F.md5(x.cast("binary")), 1, 2))))
    hs, ds, none = F.col("hs"), F.col("ds"), F.lit(False)
    pairs = F.transform(F.slice(hs, 1, F.size(hs) - 1), lambda h, i: F.struct(F.lit(True).alias("pair"), i.alias("i"), F.xxhash64(h, F.get(hs, i + 1)).alias("h"), ((F.get(ds, i) * BASE + F.get(ds, i + 1)) % divisor == 0).alias("cut")))
    singles = F.transform("lines", lambda x, i: F.when(word_count(x) >= long, F.struct(none.alias("pair"), i.alias("i"), F.get(hs, i).alias("h"), none.alias("cut"))))
    df = df.withColumn("marks", F.concat(pairs, F.filter(singles, lambda m: m.isNotNull())))
    return df.select(*KEY, F.explode(_plain("marks")).alias("m")).select(*KEY, "m.pair", "m.i", "m.h", "m.cut")


def chunks(docs: DataFrame, id_col: str, text: str, divisor: int = DIVISOR, long: int = LONG) -> DataFrame:
    """(k_id, k_text, k_crc, s, e): the chunks [s, e) of lines that may be repeated; others aren't made. They don't overlap."""
    each = marks(docs, id_col, text, divisor, long)
    at = F.struct(*KEY, "i")
    often = each.select("pair", "h", at.alias("at")).groupBy("pair", "h").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).where("lo != hi").select(F.col("pair").alias("o_pair"), F.col("h").alias("o_h"))
    often = stage(often, "repeated-marks")
    # the repeated hashes grow with the corpus: no broadcast at any size. Both sides come straight from an exchange
    met = each.join(often.hint("merge"), (each.pair == often.o_pair) & (each.h == often.o_h), "left_semi")
    # by line: does a repeated pair begin, does one end, is the line itself repeated and long
    line = F.explode(F.when(F.col("pair"), F.array(F.struct(F.col("i").alias("i"), F.lit(1).alias("begins"), F.lit(0).alias("ends"), F.lit(0).alias("alone"), F.col("cut").cast("int").alias("cut")), F.struct((F.col("i") + 1).alias("i"), F.lit(0).alias("begins"), F.lit(1).alias("ends"), F.lit(0).alias("alone"), F.lit(0).alias("cut")))).otherwise(F.array(F.struct(F.col("i").alias("i"), F.lit(0).alias("begins"), F.lit(0).alias("ends"), F.lit(1).alias("alone"), F.lit(0).alias("cut"))))).alias("l")
    lines = met.select(*KEY, line).select(*KEY, "l.*").groupBy(*KEY, "i").agg(*[F.max(c).alias(c) for c in ("begins", "ends", "cut")])
    text_lines = W.partitionBy(*KEY).orderBy("i")  # of one text
    # a cut leaves two lines or more on both sides, and none follows another at once
    cut = (F.col("begins") == 1) & (F.col("ends") == 1) & (F.col("cut") == 1) & (F.lag("ends").over(text_lines) == 1) & (F.lag("cut").over(text_lines) == 0)
    starts = (F.col("ends") == 0) | F.coalesce(cut, F.lit(False))
    numbered = lines.withColumn("number", F.sum(F.when(starts, 1).otherwise(0)).over(text_lines.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*KEY, "number").agg(F.min("i").alias("s"), (F.max("i") + 1).alias("e")).drop("number")


def passages(docs: DataFrame, id_col: str, text: str, divisor: int = DIVISOR, long: int = LONG) -> DataFrame:
    """(k_id, k_text, k_crc, spans): the chunks [s, e) of lines of each text that go, in order. A text is named by its keys;
    rows with equal id and text are one."""
    found = chunks(docs, id_col, text, divisor, long).groupBy(*[F.col(k).alias(f"c_{k}") for k in KEY]).agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    rows = docs.where(F.col(text).isNotNull()).select(*row_key(F.col(id_col), F.col(text)), F.col(text).alias("whole"))
    met = rows.join(found.hint("merge"), rows.k_id.eqNullSafe(found.c_k_id) & rows.k_text.eqNullSafe(found.c_k_text) & (rows.k_crc == found.c_k_crc))
    met = met.withColumn("lines", F.split("whole", "\n", -1)).select(*KEY, "lines", F.explode(_plain("spans")).alias("p"))
    place = F.struct(F.col("k_id").isNull().alias("z"), *KEY, "s")
    parts = met.select(*KEY, "p.s", "p.e", F.array_join(F.slice("lines", F.col("p.s") + 1, F.col("p.e") - F.col("p.s")), "\n").alias("chunk"))
    parts = stage(parts.withColumn("hash", F.xxhash64("chunk")), "chunks")
    # equal hashes count only with equal bytes: both are keys
    first = parts.groupBy("hash", "chunk").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last")
    first = stage(first.select(F.col("hash").alias("f_hash"), F.col("chunk").alias("f_chunk"), "first"), "first-chunks")
    # both sides of this join come straight from an exchange, so a very common passage can be split among tasks
    later = parts.join(first, (parts.hash == first.f_hash) & (parts.chunk == first.f_chunk)).where(place != F.col("first")).select(*KEY, "s", "e").distinct()
    out = stage(later.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans")), "passages")
    drop_staged(parts, first)
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", divisor: int = DIVISOR, long: int = LONG) -> DataFrame:
    """docs' id and text with removed_passages, removed_lines and kept_text: the text without chunks that came before.

    The first of equal chunks, which stays, is that in the smallest id (nulls last), then text hash, then line. A null text stays
    null; a text all of whose lines go becomes empty; empty lines are lines. Repeated rows (equal id and text) are one
    occurrence and are treated alike. Texts of any length are read whole, in time linear in their lines. An empty table
    gives an empty result; other columns of docs are not read, whatever their names.
    """
    gone = passages(docs, id_col, text, divisor, long)
    gone = gone.select(F.col("k_id").alias("g_id"), F.col("k_text").alias("g_text"), F.col("k_crc").alias("g_crc"), "spans")
    rows = docs.select(F.col(id_col).alias("id"), *row_key(F.col(id_col), F.col(text)), F.col(text).alias("whole"))
    j = rows.join(gone.hint("merge"), rows.k_id.eqNullSafe(gone.g_id) & rows.k_text.eqNullSafe(gone.g_text) & (rows.k_crc == gone.g_crc), "left").select("id", "whole", "spans")
    j = j.withColumn("lines", F.when(F.col("spans").isNotNull(), F.split(F.col("whole"), "\n", -1)))
    n, spans = F.size("lines"), F.col("spans")
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["e"]))
    ends = F.concat(F.transform(spans, lambda s: s["s"]), F.array(n))
    left = F.flatten(F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: F.slice(F.when(n > 0, F.col("lines")), x["s"] + 1, x["e"] - x["s"])))
    cut = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + (s["e"] - s["s"]))
    some = spans.isNotNull()
    return j.select(
        F.col("id").alias(id_col), F.col("whole").alias(text), F.when(some, F.size(spans)).otherwise(0).cast("long").alias("removed_passages"),
        F.when(some, cut).otherwise(F.lit(0).cast("long")).alias("removed_lines"), F.when(some, F.array_join(left, "\n")).otherwise(F.col("whole")).alias("kept_text"),
    )
