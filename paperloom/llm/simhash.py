"""SimHash near-duplicate classes.

Fingerprints come from one pass over the texts. Distinct fingerprints are then compared exactly: within radius r two
fingerprints agree on at least one of r + 1 bit ranges, so each is dealt to r + 1 groups by the value of a range; a
group is cut into tiles by population count, tile pairs whose population counts differ by more than r are skipped,
the others are compared whole with numpy exclusive-or and bit counts. A tile pair gives a spanning set of its links
(never all pairs), and distributed connected components join them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import drop_staged, row_hashes, row_key, stage
from paperloom.llm.components import connected_components

SEED = 42
#: Fingerprints in a tile at most; a compared unit holds two tiles.
TILE_ROWS = 8192
#: Units up to this size are compared together, by shifted copies of the sorted column.
SMALL_UNIT = 32
#: Rows and columns of one exclusive-or matrix.
STRIP = 512


def simhash(text: bytes | None, width: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a whole text: a bit is set if it is set in over half of the shingle hashes."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: n - width + 1]
    ends, total, h = ends[width - 1 :], np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(starts), 65536):
        part = np.array([h(joined[s:e], SEED) for s, e in zip(starts[k : k + 65536].tolist(), ends[k : k + 65536].tolist())], np.uint64)
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] = (), width: int = 3) -> DataFrame:
    """The columns `keep` of docs and fp, the fingerprint as a signed long. A null text counts as empty: zero."""
    kept = docs.select(*keep, F.col(text).cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(t.as_py(), width) for t in b.column(b.num_columns - 1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps, pa.int64())], names=[*b.schema.names[:-1], "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, (schema + ", " if schema else "") + "fp long")


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= radius


def sink(label: np.ndarray, names: np.ndarray, xs: slice, ys: slice, near: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Labels of two strips sink to the least of near partners until none changes; a changed label is a link."""
    old_x, old_y, out = label[xs].copy(), label[ys].copy(), []
    while True:
        lx = np.minimum(label[xs], np.where(near, label[ys][None, :], label[xs][:, None]).min(axis=1))
        ly = np.minimum(label[ys], np.where(near, lx[:, None], label[ys][None, :]).min(axis=0))
        done = (lx == label[xs]).all() and (ly == label[ys]).all()
        label[xs], label[ys] = lx, np.minimum(ly, label[ys])
        if done:
            break
    for old, s in ((old_x, xs), (old_y, ys)):
        if (m := label[s] != old).any():
            out.append((names[s][m], label[s][m]))
            out.append((old[m], label[s][m]))
    return out


def compare_unit(f: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that span the near pairs of one unit of fingerprints (uint64, sorted by population count).

    Each fingerprint holds a label, a fingerprint that it is joined to. In each strip pair labels sink to the least
    of near partners until none changes; a changed label is a link. Near pairs end with one label, so links span them.
    """
    pop, label, out = np.bitwise_count(f).astype(np.int64), f.copy(), []
    cuts = range(0, len(f), STRIP)
    for i in cuts:
        x, xs = f[i : i + STRIP], slice(i, i + STRIP)
        for j in range(i, len(f), STRIP):
            if pop[j] - pop[min(i + STRIP, len(f)) - 1] > radius:
                break  # sorted: all later strips are beyond the radius too
            y, ys = f[j : j + STRIP], slice(j, j + STRIP)
            near = _near(x, y, radius)
            if j > i and not near.any():
                continue
            out += sink(label, f, xs, ys, near)
    return out


def compare_small(unit: np.ndarray, f: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within many small units, by comparing the column with itself shifted by 1, 2, ... rows."""
    label, out = f.copy(), []
    for d in range(1, len(f)):
        same = unit[d:] == unit[:-d]
        if not same.any():
            break
        m = same & (label[d:] != label[:-d])
        m &= np.bitwise_count(f[d:] ^ f[:-d]) <= radius
        if m.any():
            out.append((f[:-d][m], f[d:][m]))
            low = np.minimum(label[:-d], label[d:])
            label[d:][m] = low[m]
    return out


def links(classes: DataFrame, radius: int = 2, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (a, b) that span all pairs of distinct fingerprints (column fp) at radius or fewer differing bits."""
    n, at = radius + 1, [round(i * 64 / (radius + 1)) for i in range(radius + 2)]
    ranges = [F.shiftrightunsigned(F.shiftleft("fp", 64 - at[i + 1]), 64 - at[i + 1] + at[i]) if n > 1 else F.col("fp") for i in range(n)]
    dealt = classes.select("fp", F.bit_count(F.col("fp")).cast("int").alias("pop"), F.posexplode(F.array(*ranges)).alias("range", "value"))
    per_pop = dealt.groupBy("range", "value", "pop").agg(F.count("*").alias("c"))
    large = per_pop.groupBy("range", "value").agg(F.sum("c").alias("c"), F.map_from_entries(F.collect_list(F.struct("pop", F.ceil(F.col("c") / tile_rows).cast("int").alias("subs")))).alias("subs")).where(F.col("c") > tile_rows)
    large = stage(large.select("range", "value", "subs"), "large-groups")
    joined = dealt.join(large, ["range", "value"], "left")
    # a small group is one unit; a row of a large group meets each tile whose population count is within the radius
    tiles = F.expr(f"""flatten(transform(sequence(greatest(pop - {radius}, 0), least(pop + {radius}, 64)), q ->
        if(coalesce(subs[q], 0) = 0, array(), transform(sequence(0, subs[q] - 1), j ->
            xxhash64(range, value, least(q, pop), greatest(q, pop),
                     if(q < pop, j, if(q > pop, pmod(xxhash64(fp), subs[pop]), least(j, pmod(xxhash64(fp), subs[pop])))),
                     if(q < pop, pmod(xxhash64(fp), subs[pop]), if(q > pop, j, greatest(j, pmod(xxhash64(fp), subs[pop])))))))))""")
    units = joined.select("fp", "pop", F.explode(F.when(F.col("subs").isNull(), F.array(F.xxhash64("range", "value"))).otherwise(tiles)).alias("unit"))
    units = units.repartition("unit").sortWithinPartitions("unit", "pop", "fp").select("unit", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_u, rest_f = np.empty(0, np.int64), np.empty(0, np.uint64)
        for b in _with_end(batches):
            if b is not None:
                rest_u = np.concatenate([rest_u, b.column(0).to_numpy(zero_copy_only=False)])
                rest_f = np.concatenate([rest_f, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            # the last unit may go on in the next batch
            whole = len(rest_u) if b is None else int(np.searchsorted(rest_u, rest_u[-1])) if len(rest_u) else 0
            u, f = rest_u[:whole], rest_f[:whole]
            rest_u, rest_f = rest_u[whole:], rest_f[whole:]
            starts = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.empty(0, np.int64)
            sizes = np.diff(np.append(starts, len(u)))
            small = np.repeat((sizes > 1) & (sizes <= SMALL_UNIT), sizes)
            found = compare_small(u[small], f[small], radius)
            for s, k in zip(starts[sizes > SMALL_UNIT], sizes[sizes > SMALL_UNIT]):
                found += compare_unit(f[s : s + k], radius)
            if found:
                a, c = (np.concatenate(x) for x in zip(*found))
                pairs = np.unique(np.stack([a, c], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].view(np.int64)), pa.array(pairs[:, 1].view(np.int64))], names=["a", "b"])

    return units.mapInArrow(run, "a long, b long")


def _with_end(batches: Iterator) -> Iterator:
    """The batches, then None."""
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2, extra: list[Column] = ()) -> DataFrame:
    """One row for each row of docs: doc_id, k_text and k_crc (hashes of the text), the columns `extra`, fp (signed long), component_id.

    component_id is the smallest id reachable over links between fingerprints at radius or fewer differing bits, the
    row's own included; null ids are skipped (null if a component has no other). Null and blank texts have
    fingerprint zero and are linked like any other; very long texts are read whole, in parts of 65,536 shingles. Repeated
    rows are kept, each with the same class. An empty table gives an empty result. Only id, text and derived columns are
    read, so other columns can't clash.
    """
    keyed = docs.select(*row_key(F.col(id_col), F.col(text)), *extra, F.col(text).alias("__t"))
    names = keyed.columns[:-1]
    fps = stage(fingerprints(keyed, "__t", names, width), "fingerprints")
    classes = stage(fps.groupBy("fp").agg(F.min("k_id").alias("least_id")), "classes")
    roots = connected_components(links(classes, radius))
    rooted = stage(roots.join(classes, roots.node == classes.fp).select("fp", "root", "least_id"), "rooted")
    least = stage(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "components")
    linked = rooted.join(least, "root").select(F.col("fp").alias("linked_fp"), "component_id")
    of_class = stage(classes.join(linked, classes.fp == F.col("linked_fp"), "left").select("fp", F.when(F.col("linked_fp").isNotNull(), F.col("component_id")).otherwise(F.col("least_id")).alias("component_id")), "class-components")
    drop_staged(rooted, least, classes)
    return fps.join(of_class, "fp").select(F.col("k_id").alias(id_col), *names[1:], "fp", "component_id")


def keep_one_per_class(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """docs with one row of each near-duplicate class: the one with the smallest id, then the smallest text hash, then the
    smallest row hash. A class whose ids are all null keeps one row as well. Columns are those of docs."""
    found = stage(near_duplicates(docs, id_col, text, width, radius, row_hashes(docs)), "dedup")
    # one key for each class; the fingerprint names a class whose ids are all null
    group = [F.col("component_id").alias("g_id"), F.when(F.col("component_id").isNull(), F.col("fp")).alias("g_fp")]
    kept = stage(least_rows(found.select(*group, F.col(id_col).alias("k_id"), "k_text", "r1", "r2"), ["g_id", "g_fp"]), "kept")
    drop_staged(found)
    return keep_rows(docs, kept)


def least_rows(rows: DataFrame, group: list[str]) -> DataFrame:
    """(r1, r2, m) of each group's least row by id (nulls last), text hash and row hash; m counts its repeats.
    rows: the columns of group, k_id, k_text, r1, r2. Both steps combine before they shuffle."""
    per_row = rows.groupBy(*group, "k_id", "k_text", "r1", "r2").agg(F.count("*").alias("m"))
    first = F.min(F.struct(F.col("k_id").isNull().alias("z"), "k_id", "k_text", "r1", "r2", "m")).alias("k")
    return per_row.groupBy(*group).agg(first).select("k.r1", "k.r2", "k.m")


def keep_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs whose row hashes are in keys (r1, r2, m), once each; m is the number of rows that share them.

    A row without repeats passes a semi join. Repeats are equal in every column, so that any of them stands for all, and
    they are combined before they are shuffled.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *row_hashes(docs))
    single = rows.join(keys.where("m = 1"), ["r1", "r2"], "left_semi").select("row")
    repeats = keys.where("m > 1")
    if repeats.isEmpty():
        return single.select("row.*")
    again = rows.join(repeats, ["r1", "r2"], "left_semi").groupBy("r1", "r2").agg(F.first("row").alias("row"))
    return single.union(again.select("row")).select("row.*")
