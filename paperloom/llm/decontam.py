"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

An item with q distinct shingles is contained in a document if the document has at least need = ceil(threshold * q)
of them. The sketch of an item is its q - need + 1 least shingle hashes (a bottom-k MinHash). At most q - need shingles of
a contained item are missing, so one of the sketch is always in the document: the search loses nothing. Items are
partitioned by q into classes of doubling size; each class has a least need and a largest hash that its sketches reach. The
sketch of a document is made of its hashes up to the largest bound of the classes that it is long enough for, less those
that a table of fixed size says no item's sketch has; only these are exploded and joined. Candidates are pairs of
document and item, and each pair is verified by itself by exact shingles, as strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import row_key, same_key, stage

WIDTH, THRESHOLD = 5, 0.8
#: Bytes of the table of sketch hashes: 16 for each hash, in powers of two between these bounds.
TABLE_LEAST, TABLE_MOST = 1 << 12, 1 << 20


def words(text: Column) -> Column:
    """Lower-cased words of a text: maximal runs of characters other than ASCII blanks. None for null."""
    bare = F.btrim(F.lower(text), F.lit(" \t\n\x0b\f\r"))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _windows(values: Column, width: int, make) -> Column:
    """make([v_i, ..., v_i+width-1]) for each window of an array column. A shorter array is one window, an empty one has
    none. values must be a plain column: an expression would be computed again for each window."""
    n = F.size(values) - width
    out = F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: make([values[i + k] for k in range(width)])))
    for short in range(1, width):
        out = out.when(n == short - width, F.array(make([values[k] for k in range(short)])))
    return out.otherwise(F.array())


def _strings(values: Column, width: int) -> Column:
    return _windows(values, width, lambda v: F.concat_ws(" ", *v)).cast("array<string>")


def items(benchmark: DataFrame, id_col: str = "item_id", text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, q, need, size_class, shingles, sketch): the distinct shingles of each item, as strings, and its sketch of hashes.

    Items shorter than one shingle have one, the whole sequence; blank and null ones have none and are left out. Rows
    with one id are one item, with the shingles of all of them.
    """
    w = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text)).alias("w"))
    s = w.select("item_id", F.explode(_strings(F.col("w"), width)).alias("shingle")).distinct()
    cut = s.withColumn("w", F.transform(F.split("shingle", " "), lambda x: F.xxhash64(x)))
    hashed = cut.select("item_id", "shingle", _windows(F.col("w"), width, lambda v: F.xxhash64(*v))[0].alias("h"))
    per = hashed.groupBy("item_id").agg(F.count("*").alias("q"), F.collect_list("shingle").alias("shingles"), F.array_sort(F.collect_set("h")).alias("hs"))
    per = per.withColumn("need", F.ceil(F.col("q") * F.lit(threshold) - 1e-9).cast("long"))
    sketch = F.slice("hs", F.lit(1), (F.col("q") - F.col("need") + 1).cast("int"))
    return per.select("item_id", "q", "need", F.floor(F.log2("q")).cast("int").alias("size_class"), "shingles", sketch.alias("sketch"))


def sketch_filter(sketch: DataFrame) -> tuple[Callable[[Column], Column], Column]:
    """(keep, bound) for documents with columns n (shingles) and hs: keep(h) is false only for hashes in no item's sketch.

    The driver reads one row for each size class and the slots of a table of TABLE_MOST bytes at most: both bounded.
    """
    classes = sketch.groupBy("size_class").agg(F.min("need").alias("need"), F.max("h").alias("most"), F.count("*").alias("c")).collect()
    bound = F.lit(None).cast("long")
    for c in classes:
        bound = F.greatest(bound, F.when(F.col("n") >= c.need, F.lit(c.most)))
    size = TABLE_LEAST
    while size < TABLE_MOST and size < 16 * sum(c.c for c in classes):
        size *= 2
    table = bytearray(size)
    for r in sketch.select(F.pmod("h", F.lit(size)).alias("slot")).distinct().collect():
        table[r.slot] = 1
    held = F.lit(bytes(table))
    return (lambda h: F.substring(held, F.pmod(h, F.lit(size)).cast("int") + 1, F.lit(1)) == F.lit(b"\x01")), bound


def contained(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, k_text, k_crc, item_id, shared, item_shingles, containment) of every pair with containment at threshold or more.

    A text under `width` words, an item's or a document's, is one shingle; blank and null ones have none. Very long
    texts are read whole. Repeated rows (equal id and text) give one row; null ids are kept. Neither side has to fit
    anywhere: hashes that no item's sketch has are dropped before anything is shuffled, and Spark broadcasts the items only
    while they are small. No join of texts is by shingle, so a passage that many documents share makes no hot key there. Only
    ids and texts are read, so other columns can't clash. An empty table gives an empty result.
    """
    it = stage(items(benchmark, item_id, item_text, width, threshold), "benchmark-items")
    sketch = stage(it.select("item_id", "need", "size_class", F.explode("sketch").alias("h")), "benchmark-sketches")
    keep, bound = sketch_filter(sketch)
    keyed = docs.select(*row_key(F.col(id_col), F.col(text)), F.col(text).alias("t"))
    hashed = keyed.select("k_id", "k_text", "k_crc", F.transform(words(F.col("t")), lambda w: F.xxhash64(w)).alias("w"))
    hashed = hashed.select("k_id", "k_text", "k_crc", F.greatest(F.size("w") - width + 1, F.least(F.size("w"), F.lit(1))).alias("n"), _windows(F.col("w"), width, lambda v: F.xxhash64(*v)).cast("array<long>").alias("hs"))
    hashed = hashed.withColumn("most", bound).withColumn("hs", F.filter("hs", lambda h: (h <= F.col("most")) & keep(h)))
    each = hashed.select("k_id", "k_text", "k_crc", "n", F.explode(F.when(F.size("hs") > 0, F.array_distinct("hs"))).alias("h"))
    side = sketch.select(F.col("h").alias("s_h"), "item_id", "need")
    hits = each.join(side, (each.h == side.s_h) & (each.n >= side.need))
    pairs = stage(hits.select("k_id", "k_text", "k_crc", "item_id").distinct(), "candidates")
    # verification reads the candidates' texts again and compares shingles as strings, pair by pair
    c = pairs.select(*[F.col(k).alias(f"c{k}") for k in ("k_id", "k_text", "k_crc")], "item_id")
    met = keyed.join(c, keyed.k_id.eqNullSafe(c.ck_id) & (keyed.k_text == c.ck_text) & (keyed.k_crc == c.ck_crc)).select("k_id", "k_text", "k_crc", "item_id", words(F.col("t")).alias("w"))
    met = met.select("k_id", "k_text", "k_crc", F.col("item_id").alias("m_id"), _strings(F.col("w"), width).alias("found"))
    met = met.join(it, met.m_id.eqNullSafe(it.item_id)).withColumn("shared", F.size(F.array_intersect("shingles", "found")).cast("long")).where(F.col("shared") >= F.col("need"))
    return met.select(F.col("k_id").alias(id_col), "k_text", "k_crc", "item_id", "shared", F.col("q").alias("item_shingles"), (F.col("shared") / F.col("q")).alias("containment")).distinct()


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """docs without the rows that contain a benchmark item; columns unchanged, rows whole, whatever the columns' names."""
    bad = stage(contained(docs, benchmark, id_col, text, **params).select(F.col(id_col).alias("k_id"), "k_text", "k_crc").distinct(), "contaminated")
    marked = docs.select(F.struct(*docs.columns).alias("row"), *row_key(F.col(id_col), F.col(text)))
    return marked.join(bad, same_key(marked, bad, ["k_id", "k_text", "k_crc"]), "left_anti").select("row.*")
