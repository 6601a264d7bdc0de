"""Sharding by fixed virtual slots, in DataFrame functions only.

Records are hashed into a fixed number of virtual slots; bytes are summed per slot; a versioned map takes slots to
shards. The map has a fixed number of rows, so it is the only thing that is broadcast. A first map is built by giving
the largest slots out first, each to the lightest shard; later versions are edits that move as few slots as balance
needs, and only onto shards that are new.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.llm.common import shared_dir, stage

#: Virtual slots. Fixed for the life of a dataset: the map, not the hash, changes.
SLOTS = 8192
#: Bytes that a record takes besides its text.
OVERHEAD = 8
#: Equal records of one slot at most, about.
PACKET = 1024


def records(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' id (as rec_id), size and text_crc32. A null text has no bytes and checksum 0."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("rec_id"), (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"))


def slot_of(rec_id: Column, crc: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(rec_id, crc), F.lit(slots)).cast("int")


def packets(recs: DataFrame, slots: int = SLOTS, packet: int = PACKET) -> DataFrame:
    """recs in packets of at most `packet` equal records: rec_id, size, text_crc32, part, m (records), virtual_slot. The first
    packet's slot is that of its record; further ones, of very many equal records, go to other slots. Records are combined
    before they are shuffled."""
    m = recs.groupBy("rec_id", "size", "text_crc32").agg(F.count("*").alias("all"))
    m = m.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(all - 1) div {packet}"))))
    slot = F.when(F.col("part") == 0, slot_of(F.col("rec_id"), F.col("text_crc32"), slots)).otherwise(F.pmod(F.xxhash64("rec_id", "text_crc32", "part"), F.lit(slots)).cast("int"))
    return m.select("rec_id", "size", "text_crc32", "part", F.least(F.lit(packet).cast("long"), F.col("all") - F.col("part") * packet).alias("m"), slot.alias("virtual_slot"))


def slot_loads(packs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, bytes, rows) of every slot, empty ones included: a table of `slots` rows."""
    every = packs.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    sums = packs.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("m")).alias("bytes"), F.sum("m").alias("rows"))
    return every.join(sums, "virtual_slot", "left").na.fill(0, ["bytes", "rows"])


def _deal(slots: DataFrame, loads: Column) -> DataFrame:
    """(virtual_slot, shard, bytes, rows): slots, the largest first, each to the lightest shard; loads holds what the shards have."""
    # one row holds all slots: their number is fixed
    all_slots = slots.agg(F.reverse(F.array_sort(F.collect_list(F.struct("bytes", "rows", "virtual_slot")))).alias("xs"))
    zero = F.struct(loads.alias("load"), F.array().cast("array<int>").alias("out"))

    def give(acc, x):
        to = F.array_position(acc["load"], F.array_min(acc["load"])) - 1
        load = F.transform(acc["load"], lambda v, i: F.when(i == to, v + x["bytes"] + F.lit(1)).otherwise(v))
        return F.struct(load.alias("load"), F.concat(acc["out"], F.array(to.cast("int"))).alias("out"))

    dealt = all_slots.select("xs", F.aggregate("xs", zero, give, lambda acc: acc["out"]).alias("out"))
    pairs = dealt.select(F.explode(F.arrays_zip("xs", "out")).alias("p"))
    return pairs.select("p.xs.virtual_slot", F.col("p.out").alias("shard"), "p.xs.bytes", "p.xs.rows")


def build_map(loads: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map: (version, virtual_slot, shard, bytes, rows). Largest slot first, to the lightest shard."""
    return _deal(loads, F.array_repeat(F.lit(0).cast("long"), shards)).select(F.lit(1).alias("version"), "virtual_slot", "shard", "bytes", "rows")


def rebalance_map(current: DataFrame, loads: DataFrame, shards: int, slack: float = 0.02) -> DataFrame:
    """The next version for changed loads at the same number of shards: each shard keeps its largest slots up to the mean of
    bytes and `slack` above, at least one; the others go, the largest first, to the lightest shards. Other slots don't move."""
    m = current.select("version", "virtual_slot", "shard").join(loads, "virtual_slot")
    most = F.sum("bytes").over(W.partitionBy()) / shards * (1 + slack)
    order = W.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    kept = (F.sum("bytes").over(order.rowsBetween(W.unboundedPreceding, 0)) <= F.col("most")) | (F.row_number().over(order) == 1)
    m = stage(m.withColumn("most", most).withColumn("kept", kept).select((F.col("version") + 1).alias("version"), "virtual_slot", "shard", "bytes", "rows", "kept"), "slots-kept")
    # two tables of fixed size: what each shard keeps, and what is dealt anew
    held = {r.shard: r.b for r in m.where("kept").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    dealt = _deal(m.where("not kept"), F.array(*[F.lit(held.get(k, 0)).cast("long") for k in range(shards)]))
    stay = m.where("kept").select("version", "virtual_slot", "shard", "bytes", "rows")
    version = F.lit((m.agg(F.max("version")).first()[0]) or 1)
    return stay.union(dealt.select(version.alias("version"), "virtual_slot", "shard", "bytes", "rows"))


def grow_map(current: DataFrame, loads: DataFrame, shards: int, more: int) -> DataFrame:
    """The next version, for `shards + more` shards: each old shard keeps its largest slots up to the new mean of bytes and
    gives the others to the new shards. No slot moves between old shards."""
    m = current.select("version", "virtual_slot", "shard").join(loads, "virtual_slot")
    mean = F.sum("bytes").over(W.partitionBy()) / (shards + more)
    order = [F.desc("bytes"), "virtual_slot"]
    m = m.withColumn("mean", mean).withColumn("kept", F.sum("bytes").over(W.partitionBy("shard").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) <= F.col("mean"))
    freed = F.sum(F.when(~F.col("kept"), F.col("bytes")).otherwise(0)).over(W.orderBy("kept", *order).rowsBetween(W.unboundedPreceding, 0))
    to = F.lit(shards) + F.least(F.floor((freed - F.col("bytes")) / F.greatest(F.col("mean"), F.lit(1.0))), F.lit(more - 1))
    return m.select((F.col("version") + 1).alias("version"), "virtual_slot", F.when(F.col("kept"), F.col("shard")).otherwise(to.cast("int")).alias("shard"), "bytes", "rows")


def save_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored map; versions that are there stay."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the stored map, the latest by default."""
    m = spark.read.parquet(path)
    version = version if version is not None else m.agg(F.max("version")).first()[0]
    return m.where(F.col("version") == version).select("version", "virtual_slot", "shard", "bytes", "rows")


def store_map(loads: DataFrame, shards: int, more: int = 0, path: str | None = None) -> str:
    """The path of the stored map for loads, a new folder unless given. A new map gets version 1; one that is there is edited
    for the loads at hand, and its latest version is the next. With `more` another edit adds so many shards."""
    spark = loads.sparkSession
    loads = stage(loads, "slot-loads")
    if path is not None and stored(spark, path):
        save_map(rebalance_map(load_map(spark, path), loads, shards), path)
    else:
        path = path or f"{shared_dir(spark)}/paperloom/{spark.sparkContext.applicationId}/slot-map-{uuid.uuid4().hex}"
        save_map(build_map(loads, shards), path)
    if more:
        save_map(grow_map(load_map(spark, path), loads, shards, more), path)
    return path


def stored(spark: SparkSession, path: str) -> bool:
    """Whether a map is stored at path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def shard_docs(docs: DataFrame, shards: int, id_col: str = "doc_id", text: str = "text", slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """docs with virtual_slot, shard and map_version; columns of docs with these names are replaced. The texts are not shuffled.
    The map is stored at path, or edited where one is there. Rows that are equal in id and text share a slot. Null ids and
    texts are hashed like values, texts of any length by all their bytes. An empty table gives an empty result."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slot = slot_of(F.col(id_col), F.crc32(raw).cast("long"), slots)
    packs = records(docs, id_col, text).select(slot_of(F.col("rec_id"), F.col("text_crc32"), slots).alias("virtual_slot"), "size", F.lit(1).cast("long").alias("m"))
    at = store_map(slot_loads(packs, slots), shards, path=path)
    slot_map = F.broadcast(load_map(docs.sparkSession, at).select("virtual_slot", "shard", F.col("version").alias("map_version")))
    mine = docs.withColumn("virtual_slot", slot).drop("shard", "map_version")
    return mine.join(slot_map, "virtual_slot").select(*[c for c in docs.columns if c not in ("virtual_slot", "shard", "map_version")], "virtual_slot", "shard", "map_version")


def place(docs: DataFrame, shards: int, id_col: str = "doc_id", text: str = "text", slots: int = SLOTS, more: int = 0, path: str | None = None) -> DataFrame:
    """One row for each row of docs: its id, size, text_crc32, virtual_slot, shard, map_version and slot, the row's
    place in its shard (0, 1, ... without gaps).

    A place is the number of rows in the shard's earlier virtual slots, from the map, plus the place within the
    virtual slot, so a task sorts a virtual slot at most. Null ids hash like a value; rows that are equal in id and text
    are numbered from their count, in packets that are spread over slots, so that no group of them is one slot's load.
    Texts of any length count by all their bytes. An empty table gives an empty result; only id and text are read. All is
    taken from the stored map's latest version; with `more`, grown_shard is the shard in the version after it, which has
    that many shards more.
    """
    packs = stage(packets(records(docs, id_col, text), slots), "packets")
    at = store_map(slot_loads(packs, slots), shards, more, path)
    spark = docs.sparkSession
    last = load_map(spark, at).first()
    version = (last.version if last is not None else 1) - (1 if more else 0)
    slot_map = load_map(spark, at, version)
    if more:
        grown = load_map(spark, at, version + 1).select("virtual_slot", F.col("shard").alias("grown_shard"))
        slot_map = slot_map.join(grown, "virtual_slot")
    before = F.sum("rows").over(W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, 0)) - F.col("rows")
    extra = ["grown_shard"] if more else []
    starts = F.broadcast(slot_map.select("virtual_slot", "shard", before.alias("start"), F.col("version").alias("map_version"), *extra))
    order = W.partitionBy("virtual_slot").orderBy(F.col("rec_id").asc_nulls_first(), "text_crc32", "size", "part").rowsBetween(W.unboundedPreceding, 0)
    placed = packs.withColumn("n", F.sum("m").over(order) - F.col("m")).join(starts, "virtual_slot")
    placed = placed.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    return placed.select(F.col("rec_id").alias(id_col), "size", "text_crc32", "shard", (F.col("start") + F.col("n") + F.col("j")).cast("long").alias("slot"), "virtual_slot", "map_version", *extra)
