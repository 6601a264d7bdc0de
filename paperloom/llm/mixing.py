"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Targets come from the sizes of the sources (water filling). A source's rate, target over size, gives each document a
whole number of copies and a fraction. The fractions are rounded dependently: two documents at a time, mass (size
times fraction) is moved at random from one to the other until one fraction is 0 or 1, with odds that keep every
expectation. A block of documents leaves one fractional residual; residuals of blocks meet in the blocks above, a
tree of fixed fan-in, so the words taken differ from a target by less than one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.llm.common import drop_staged, row_hashes, stage, word_count

#: Children of a block in the reduction tree.
FAN_IN = 64
#: Mean number of documents in a leaf block.
LEAF = 32


def uniform(*cols: Column | str, seed: int = 7) -> Column:
    """A number in [0, 1) that depends on the values alone, so that reruns and recomputed tasks agree."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def water_fill(sources: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sources (source, source_size) with weight and target: share of all sizes by weight, none above cap times its size.

    Sources take the weights in turn by code point, null last. The windows run over the table of sources (one row
    for each), never over documents. In order of the ratio at which it fills up, a source is full if its ratio is
    at most the level of what is left for it and those after.
    """
    by_name, every = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("ratio", F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", w.cast("double")).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    s = s.withColumn("ratio", F.col("most") / F.col("weight"))
    to_here, to_end = every.rowsBetween(W.unboundedPreceding, -1), every.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))
    s = s.withColumn("level", (total - F.coalesce(F.sum("most").over(to_here), F.lit(0.0))) / F.sum("weight").over(to_end))
    s = s.withColumn("full", F.min(F.col("ratio") <= F.col("level")).over(every.rowsBetween(W.unboundedPreceding, 0)))
    # the level of the first source that isn't full holds for all of those
    s = s.withColumn("last", F.min(F.when(~F.col("full"), F.struct("ratio", "level"))).over(W.partitionBy()))
    return s.select("source", "source_size", "weight", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * F.col("last.level")).alias("target"))


def _meet(acc: Column, x: Column, seed: int) -> Column:
    """One pivotal step: the residual of acc meets the unit x; the one that becomes integral is done."""
    a = acc["rest"]
    a_up, b_dn = (1 - a["p"]) * a["s"], x["p"] * x["s"]  # mass that lifts a to 1, mass that x can give
    a_dn, b_up = a["p"] * a["s"], (1 - x["p"]) * x["s"]
    up, dn = F.least(a_up, b_dn), F.least(a_dn, b_up)
    lift = uniform(a["h"], x["h"], seed=seed) * (up + dn) < dn

    def done(u: Column, extra: int) -> Column:
        return F.struct(u["id"].alias("id"), u["t"].alias("t"), u["c"].alias("c"), u["s"].alias("s"), u["m"].alias("m"), (u["whole"] + F.lit(extra)).alias("extra"))

    def rest(u: Column, p: Column) -> Column:
        fields = [u[n].alias(n) for n in ("h", "id", "t", "c", "s", "m", "whole")]
        return F.struct(*fields, F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"))

    settle_a = (lift & (a_up <= b_dn)) | (~lift & (a_dn <= b_up))
    moved = F.when(settle_a, F.when(lift, x["p"] - a_up / x["s"]).otherwise(x["p"] + a_dn / x["s"])).otherwise(F.when(lift, a["p"] + b_dn / a["s"]).otherwise(a["p"] - b_up / a["s"]))
    gone = F.when(settle_a, F.when(lift, done(a, 1)).otherwise(done(a, 0))).otherwise(F.when(lift, done(x, 0)).otherwise(done(x, 1)))
    left = F.when(settle_a, rest(x, moved)).otherwise(rest(a, moved))
    met = F.struct(left.alias("rest"), F.concat(acc["done"], F.array(gone)).alias("done"))
    return F.when(a.isNull(), F.struct(rest(x, x["p"]).alias("rest"), acc["done"].alias("done"))).otherwise(met)


def allocate(units: DataFrame, rates: DataFrame, seed: int = 7) -> DataFrame:
    """Copies of each unit. units (source, id, t, c, s, m): m rows of size s that are repeats of one another; rates
    (source, rate). Returns source, id, t, c, s, m, total: the copies that the m rows have together.

    A unit's m equal fractions sum to a whole number, kept, and one fraction that goes into the tree.
    """
    u = units.join(rates, units.source.eqNullSafe(rates.r_source))
    u = u.withColumn("base", F.floor("rate")).withColumn("f", (F.col("rate") - F.floor("rate")) * F.col("m")).withColumn("whole", F.floor("f").cast("long"))
    u = u.withColumn("p", F.col("f") - F.col("whole")).withColumn("h", F.xxhash64("id", "t", "c", "s", F.lit(seed)))
    u = u.withColumn("blocks", F.greatest(F.ceil(F.col("n_units") / LEAF), F.lit(1)).cast("long"))
    # empty documents carry no mass: each is rounded by itself
    free = (F.col("p") <= 0) | (F.col("s") <= 0)
    cols = ["source", "id", "t", "c", "s", "m"]
    alone = u.where(free).select(*cols, (F.col("whole") + (uniform("h", seed=seed) < F.col("p")).cast("long")).alias("extra"))
    nodes = u.where(~free).select("source", F.pmod("h", "blocks").alias("block"), F.struct("h", "id", "t", "c", F.col("s").cast("double").alias("s"), "m", "whole", "p").alias("rest"))
    top = rates.agg(F.max("n_units")).first()[0] or 0
    width, level, decided = -(-top // LEAF), 0, []
    rest_type = nodes.schema["rest"].dataType.simpleString()
    done_type = rest_type.replace("h:bigint,", "", 1).replace("whole:bigint,p:double", "extra:bigint")
    zero = F.struct(F.lit(None).cast(rest_type).alias("rest"), F.array().cast(f"array<{done_type}>").alias("done"))
    while True:
        grouped = nodes.groupBy("source", "block").agg(F.array_sort(F.collect_list("rest")).alias("xs"))
        folded = grouped.select("source", "block", F.aggregate("xs", zero, lambda acc, x: _meet(acc, x, seed + level)).alias("f"))  # noqa: B023
        folded = stage(folded.select("source", "block", "f.rest", "f.done"), f"mix-level{level}")
        decided.append(folded.select("source", F.explode("done").alias("d")).select("source", "d.id", "d.t", "d.c", F.col("d.s").cast("long").alias("s"), "d.m", "d.extra"))
        nodes = folded.select("source", F.expr(f"block div {FAN_IN}").alias("block"), "rest")
        if width <= 1:
            break
        width, level = -(-width // FAN_IN), level + 1
    last = nodes.select("source", "rest.id", "rest.t", "rest.c", F.col("rest.s").cast("long").alias("s"), "rest.m", (F.col("rest.whole") + (uniform("rest.h", seed=seed + 99) < F.col("rest.p")).cast("long")).alias("extra"))
    for d in [alone, last]:
        decided.append(d)
    out = decided[0]
    for d in decided[1:]:
        out = out.union(d)
    out = out.join(rates.select("r_source", F.floor("rate").alias("base")), out.source.eqNullSafe(F.col("r_source")))
    return out.select(*cols, (F.col("m") * F.col("base") + F.col("extra")).cast("long").alias("total"))


def _units(docs: DataFrame, id_col: str, text: str, source: str) -> DataFrame:
    rows = docs.select(F.col(source).alias("source"), F.col(id_col).alias("id"), *[c.alias(n) for n, c in zip("tc", row_hashes(docs))], word_count(F.col(text)).alias("s"))
    return rows.groupBy("source", "id", "t", "c", "s").agg(F.count("*").alias("m"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(allocation, targets). allocation: source, id, t, c (hashes of the whole row), s (words), m (rows), total (copies of
    the m rows together, none of them above cap rounded up); targets: source, source_size, weight, target.

    A null text has size 0; null sources form one source, last in order; null ids are ids like any other. Rows that
    are equal in all columns are repeats and share their copies; rows that differ in any are units of their own. Texts are
    read whole, at any length. If all sizes are 0, targets are 0 and nothing is taken. An empty table gives empty results.
    Other columns only enter the hashes, so their names can't clash.
    """
    units = stage(_units(docs, id_col, text, source), "mix-units")
    sums = stage(units.groupBy("source").agg(F.sum(F.col("s") * F.col("m")).cast("long").alias("source_size"), F.count("*").alias("n_units")), "mix-sizes")
    targets = stage(water_fill(sums.select("source", "source_size"), weights, share, cap), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    counts = sums.select(F.col("source").alias("n_source"), "n_units")
    rates = stage(targets.join(counts, targets.source.eqNullSafe(counts.n_source)).select(F.col("source").alias("r_source"), rate.alias("rate"), "n_units"), "mix-rates")
    drop_staged(sums)
    return allocate(units, rates, seed), targets


def _explode_count(n: Column, block: int = 4096) -> tuple[Column, Column]:
    """Two nested ranges that make n rows without one array of n: outer block numbers, and rows within block `b`."""
    outer = F.when(n > 0, F.sequence(F.lit(0).cast("long"), F.expr("0L") + F.floor((n - 1) / block).cast("long")))
    inner = F.sequence(F.col("b") * block + 1, F.least(n, (F.col("b") + 1) * block))
    return outer, inner


def taken_rows(allocation: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each row of the documents: id, size, source_size, target, copies, taken."""
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    a = allocation.join(t, allocation.source.eqNullSafe(t.t_source))
    outer, inner = _explode_count(F.col("m"))
    a = a.withColumn("b", F.explode(outer)).withColumn("j", F.explode(inner))
    copies = F.expr("total div m + if(j <= total % m, 1, 0)").cast("long")
    return a.select("id", F.col("s").alias("size"), "source_size", F.col("target").cast("double").alias("target"), copies.alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **params) -> DataFrame:
    """The mixture itself: the rows of docs, each as often as its copies say, columns unchanged. Rows that are equal in all
    columns share their copies; each copy of a row is that row, whole. Rows are shuffled once."""
    allocation, _ = mix(docs, id_col, text, source, **params)
    a = stage(allocation.where("total > 0").select(F.col("t").alias("r1"), F.col("c").alias("r2"), "m", "total"), "mix-allocation")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *row_hashes(docs))
    one = rows.join(a.where("m = 1"), ["r1", "r2"]).select("row", "total")
    repeats = a.where("m > 1")
    if not repeats.isEmpty():  # equal throughout: any of them stands for all; combined before they are shuffled
        again = rows.join(repeats, ["r1", "r2"]).groupBy("r1", "r2").agg(F.first("row").alias("row"), F.first("total").alias("total"))
        one = one.union(again.select("row", "total"))
    outer, inner = _explode_count(F.col("total"))
    return one.select("row", "total", F.explode(outer).alias("b")).select("row", F.explode(inner).alias("j")).select("row.*")
