"""Fill-in-middle by an index of distinct texts.

Texts are grouped by content: rows whose hash occurs once are groups by themselves and never move; others are grouped by
the text, so Spark compares bytes. The token boundaries of each distinct text are found once and kept as an Elias-Fano
list, about log2(mean token length) + 2 bits a boundary. The index is joined back to the documents by hash and text, and
each document selects its two seeded cuts from the list without decoding it. Output and its reversal are Spark functions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import stage

MARKS = ("<P>", "<S>", "<M>")
#: Bits of the sieve that tells hashes which occur once: its size is fixed. Where it is full, more rows take the way of repeated texts.
SIEVE_BITS = 1 << 25
#: Characters of a text that are looked at together.
SLICE = 1 << 20
#: Set bits of each byte value.
ONES = np.array([bin(b).count("1") for b in range(256)], np.int64)


def boundaries(text: str, size: int = SLICE) -> np.ndarray:
    """Ends of the tokens of text in code points; a token is a word with the blanks before it, or blanks at the end."""
    found, n = [], len(text)
    for start in range(0, n, size):
        cp = np.frombuffer(text[start : start + size + 1].encode("utf-32-le"), np.uint32)
        blank = (cp == 32) | ((cp >= 9) & (cp <= 13))
        if start + size >= n:  # what ends the text ends a token, blank or not
            ends = np.append(~blank[:-1] & blank[1:], True)
        else:
            ends = ~blank[:-1] & blank[1:]
        found.append(np.flatnonzero(ends) + start + 1)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def encode(ends: np.ndarray, universe: int) -> bytes:
    """An Elias-Fano list of ascending numbers up to universe: count, low width, low bits packed, high parts in unary."""
    n = len(ends)
    width = max(0, int(universe // n).bit_length() - 1) if n else 0
    low = (ends[:, None] >> np.arange(width)) & 1
    high = np.zeros(n + (universe >> width) + 1, np.uint8)
    high[(ends >> width) + np.arange(n)] = 1
    return np.int64(n).tobytes() + bytes([width]) + np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes() + np.packbits(high, bitorder="little").tobytes()


def length(coded: bytes) -> int:
    return int.from_bytes(coded[:8], "little")


def select(coded: bytes, k: int) -> int:
    """The k-th number of the list, from 0."""
    n, width = length(coded), coded[8]
    split = 9 + (n * width + 7) // 8
    high = np.frombuffer(coded, np.uint8, offset=split)
    upto = np.cumsum(ONES[high])
    at = int(np.searchsorted(upto, k + 1))
    before = int(upto[at - 1]) if at else 0
    bit = int(np.flatnonzero(np.unpackbits(high[at : at + 1], bitorder="little"))[k - before])
    first = k * width
    word = int.from_bytes(coded[9 + first // 8 : 9 + (first + width + 7) // 8], "little")
    return ((at * 8 + bit - k) << width) | ((word >> first % 8) & ((1 << width) - 1))


@F.pandas_udf(T.BinaryType())
def boundary_list(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: encode(boundaries(t), len(t)))


@F.pandas_udf(T.StructType([T.StructField(k, T.LongType()) for k in ("n", "a", "b")]))
def cut_points(coded: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
    """Number of tokens and the two cuts in code points, in order."""
    out = []
    for c, x, y in zip(coded, h1, h2, strict=True):
        n = length(c)
        cuts = [select(c, k - 1) if k else 0 for k in sorted((x % (n + 1), y % (n + 1)))]
        out.append((n, *cuts))
    return pd.DataFrame(out, columns=["n", "a", "b"])


def draw(id_col: Column, seed: int, k: int) -> Column:
    """The k-th number drawn for a document: eight digits of the SHA-256 of seed:id. A null id counts as the word null."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def _sieve(often: DataFrame, bits: int):
    """A test on hashes, true for all of `often`: a bitmap of fixed size is all that comes to the driver."""
    slot = F.pmod(F.col("h"), F.lit(bits))
    words = often.select(slot.alias("slot")).selectExpr("cast(slot div 64 as int) AS word", "shiftleft(1L, cast(slot % 64 as int)) AS bit")
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros((bits + 63) // 64, np.int64)
    bitmap[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    shared = often.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    @F.pandas_udf("boolean")
    def passes(h: pd.Series) -> pd.Series:
        at = h.to_numpy() % bits
        return pd.Series((np.frombuffer(shared.value, np.int64)[at >> 6] >> (at & 63)) & 1 == 1)

    return passes


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of. Texts with a mark are plain, so each mark stands once in other outputs."""
    p, s, m = MARKS
    last = F.split_part(output, F.lit(m), F.lit(2))
    head = F.split_part(output, F.lit(m), F.lit(1))
    psm = F.concat(F.substring(F.split_part(head, F.lit(s), F.lit(1)), F.lit(len(p) + 1), F.length(head)), last, F.split_part(head, F.lit(s), F.lit(2)))
    spm = F.concat(F.split_part(head, F.lit(p), F.lit(2)), last, F.substring(F.split_part(head, F.lit(p), F.lit(1)), F.lit(len(s) + 1), F.length(head)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def transform(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80, bits: int = SIEVE_BITS) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for each row: the text cut at two token boundaries drawn by seed and id.

    A null text is empty. An empty text, and one that holds a mark, is plain: its output is the text, its lengths are null.
    Both cuts may fall together, so parts may be empty. Rows of equal text have one boundary list, however many they are,
    and cuts of their own; rows of equal id and text are equal. Texts of any length are read whole, each within one task.
    A null id draws as the word null. An empty table gives an empty result; other columns aren't read, whatever their names.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), body.alias("body"), F.xxhash64(body).alias("h"))
    often = rows.groupBy("h").count().where("count > 1").select("h")
    passes = _sieve(often, bits)
    rows = rows.withColumn("again", passes("h"))
    shared = rows.where("again").select("id", "body", "h")
    index = stage(shared.select("h", "body").distinct().select(F.col("h").alias("i_h"), F.col("body").alias("i_body"), boundary_list("body").alias("coded")), "boundary-lists")
    # both sides come straight from an exchange, so the rows of a very common text can be split among tasks
    joined = shared.join(index, (shared.h == index.i_h) & (shared.body == index.i_body)).select("id", "body", "coded")
    alone = rows.where(~F.col("again")).select("id", "body", boundary_list("body").alias("coded"))
    each = joined.union(alone).select("id", "body", cut_points("coded", draw(F.col("id"), seed, 1), draw(F.col("id"), seed, 2)).alias("c"))
    p, s, m = MARKS
    marked = F.contains("body", F.lit(p)) | F.contains("body", F.lit(s)) | F.contains("body", F.lit(m))
    plain = (F.col("body") == "") | marked | (draw(F.col("id"), seed, 3) % 100 >= percent)
    form = F.when(plain, "plain").when(draw(F.col("id"), seed, 4) % 100 < spm_percent, "spm").otherwise("psm")
    a, b = F.col("c.a").cast("int"), F.col("c.b").cast("int")
    each = each.select(
        "id", "body", "c", form.alias("form"), F.substring("body", F.lit(1), a).alias("prefix"), F.substring("body", a + 1, b - a).alias("middle"),
        F.substring("body", b + 1, F.length("body")).alias("suffix"),
    )
    psm, spm = F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle"), F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle")
    cut = F.col("form") != "plain"
    return each.select(
        F.col("id").alias(id_col), F.col("c.n").alias("n"), "form", F.when(cut, F.col("c.a")).alias("prefix_chars"), F.when(cut, F.col("c.b") - F.col("c.a")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("body")).alias("output"),
    )
