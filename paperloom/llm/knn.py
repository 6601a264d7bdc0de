"""Exact top-k search by inner product as a Voronoi kNN join (after Lu et al., 2012).

Rows are put into the cell of the nearest pivot; pivots are rows picked by hash, and their number grows with the root of
the table. Cells are packed with their neighbours into blocks of bounded size, and a larger cell is cut into several. Each
query is first solved against the block of its own cell, which gives a score that it is sure to reach k times. A cell with
pivot p and radius r (the greatest distance of its rows from p) holds no score above y.p + |y| r for a query y; so a
query goes on only to blocks with a cell that may beat its own k-th score, and never to its first block again. Units of one
block and a bounded number of queries are solved exactly with matrix products; a last merge keeps k of each query's results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.llm.common import drop_staged, stage

#: Queries of a unit, and rows of a block, about; a small table is still cut into so many blocks.
GROUP_QUERIES, BLOCK_ROWS, LEAST_BLOCKS = 2048, 8192, 16


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, is_query: Column, scale: float = 64.0) -> DataFrame:
    """(vec_id, is_query, v): v holds floor(scale * x) of each component as little-endian doubles' bytes.
    Null vectors and vectors with null or non-finite components are left out."""
    v = F.col(vec_col).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = df.select(F.col(id_col).alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), v.alias("v"), fine.alias("fine"))
    rows = rows.where("fine").select("vec_id", "is_query", "v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vs = [np.floor(scale * np.asarray(x, np.float64)).tobytes() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(vs, pa.binary())], names=["vec_id", "is_query", "v"])

    return rows.mapInArrow(pack, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, is_query boolean, v binary")


def matrix(blobs: list[bytes], dim: int) -> np.ndarray:
    """The packed vectors as rows; shorter ones are padded with zeros."""
    if all(len(b) == 8 * dim for b in blobs):
        return np.frombuffer(b"".join(blobs), np.float64).reshape(-1, dim)
    out = np.zeros((len(blobs), dim))
    for i, b in enumerate(blobs):
        x = np.frombuffer(b, np.float64)
        out[i, : len(x)] = x
    return out


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products as long. Doubles are exact to 2^53; beyond, Python integers; beyond long, the nearest long."""
    most = (np.abs(q).max(initial=0) * np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2.0**53:
        return (q @ x.T).astype(np.int64)
    big = np.array([[int(v) for v in r] for r in q], object).reshape(q.shape) @ np.array([[int(v) for v in r] for r in x], object).reshape(x.shape).T
    low, high = -(2**63), 2**63 - 1
    return np.array([[min(max(v, low), high) for v in r] for r in big], np.int64).reshape(len(q), len(x))


def best(score: np.ndarray, ids: np.ndarray, rids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: score descending, then id, then row."""
    if len(score) > k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        over = np.flatnonzero(score > cut)
        ties = np.flatnonzero(score == cut)
        at = np.concatenate([over, ties[np.lexsort((rids[ties], ids[ties]))[: k - len(over)]]])
    else:
        at = np.arange(len(score))
    return at[np.lexsort((rids[at], ids[at], -score[at].astype(np.float64) if np.abs(score[at]).max(initial=0) < 2**53 else np.array([-int(s) for s in score[at]], object)))]


def plan_blocks(pivots: np.ndarray, counts: dict[int, int], block_rows: int) -> dict[int, tuple[int, int]]:
    """For each cell its first block and its number of blocks: small cells share a block with neighbours, a large one is cut.

    Neighbours are cells next to one another in the order of a projection of their pivots.
    """
    cells = sorted(counts)
    with np.errstate(over="ignore", invalid="ignore"):
        spread = pivots[cells] - pivots[cells].mean(axis=0)
        axis = spread.T @ (spread @ np.ones(spread.shape[1]))
        order = np.argsort(np.nan_to_num(spread @ axis), kind="stable")
    out, block, filled = {}, 0, 0
    for c in (cells[i] for i in order):
        parts = -(-counts[c] // block_rows)
        if parts > 1:
            if filled:
                block, filled = block + 1, 0
            out[c], block = (block, parts), block + parts
            continue
        if filled and filled + counts[c] > block_rows:
            block, filled = block + 1, 0
        out[c], filled = (block, 1), filled + counts[c]
    return out


def _solve(k: int, dim: int):
    def solve(t: pa.Table) -> pa.Table:
        asks, rid, ids = t.column("asks").to_numpy(), t.column("rid").to_numpy(), t.column("vec_id").to_pylist()
        place = {v: n for n, v in enumerate(sorted({v for v in ids if v is not None}))}
        order = np.array([place.get(v, len(place)) for v in ids], np.int64)
        rows_at, query_at, blobs = np.flatnonzero(~asks), np.flatnonzero(asks), t.column("v")
        asked, found, scores = [], [], []
        if len(rows_at):
            x, xr, xo = matrix(blobs.take(pa.array(rows_at)).to_pylist(), dim), rid[rows_at], order[rows_at]
            for s in range(0, len(query_at), 256):
                part = query_at[s : s + 256]
                for i, row in zip(part, inner_products(matrix(blobs.take(pa.array(part)).to_pylist(), dim), x)):
                    others = np.flatnonzero(xr != rid[i])
                    at = others[best(row[others], xo[others], xr[others], k)]
                    asked.append(np.full(len(at), i))
                    found.append(rows_at[at])
                    scores.append(row[at])
        q, r, score = (np.concatenate(a) if a else np.empty(0, np.int64) for a in (asked, found, scores))
        names = t.column("vec_id")
        return pa.table({"q_rid": rid[q], "query_id": names.take(pa.array(q)), "rid": rid[r], "vec_id": names.take(pa.array(r)), "score": score})

    return solve


def _units(data: DataFrame, queries: DataFrame, group_queries: int) -> DataFrame:
    """Rows of the units (block, split): data (block, rid, vec_id, v) and queries (block, rid, vec_id, v). The queries of a
    block are split by hash into parts of about group_queries, and only a block that has queries is sent, once for each part."""
    splits = stage(queries.groupBy(F.col("block").alias("s_block")).agg(F.ceil(F.count("*") / group_queries).cast("int").alias("splits")), "splits")
    at = lambda df: df.join(splits, df.block == splits.s_block)
    cols = ["rid", "vec_id", "v"]
    asked = at(queries).select("block", F.expr("cast(pmod(xxhash64(rid), splits) as int)").alias("split"), F.lit(True).alias("asks"), *cols)
    rows = at(data).select("block", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"), F.lit(False).alias("asks"), *cols)
    return asked.union(rows)


def search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, scale: float = 64.0, pivots: int | None = None, group_queries: int = GROUP_QUERIES, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame] | None:
    """(results, visits): local results (q_rid, query_id, rid, vec_id, score), and the blocks that each query visits (rid,
    block, rows). None if there are no rows or no queries."""
    packed = integer_vectors(df, id_col, vec_col, is_query, scale)
    id_type = packed.schema["vec_id"].dataType.simpleString()
    rows = stage(packed.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    n, n_q, dim = rows.agg(F.count("*"), F.count_if("is_query"), F.max(F.expr("length(v) div 8"))).first()
    if not n or not n_q:
        return None
    dim = max(int(dim), 1)
    wanted = pivots or max(1, int(n**0.5 / 4))
    # pivots are rows picked by hash, about the root of their number
    picked = rows.select("v", F.xxhash64("v", "vec_id").alias("h")).orderBy("h", "v").limit(2 * wanted).select("v").distinct().collect()
    p = matrix(sorted(bytes(r.v) for r in picked)[:wanted], dim)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, dists = [], []
            for s in range(0, b.num_rows, 1024):
                x = matrix(b.column("v").slice(s, 1024).to_pylist(), dim)
                with np.errstate(over="ignore", invalid="ignore"):
                    cell = np.nan_to_num((x**2).sum(1)[:, None] - 2 * x @ p.T + (p**2).sum(1)[None, :], nan=np.inf).argmin(axis=1)
                    dists.append(np.linalg.norm(x - p[cell], axis=1))
                cells.append(cell)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(cells or [[]]), pa.int32()), pa.array(np.concatenate(dists or [[]]), pa.float64())], names=[*b.schema.names, "cell", "dist"])

    dealt = stage(rows.mapInArrow(assign, f"vec_id {id_type}, is_query boolean, v binary, rid long, cell int, dist double"), "cells")
    drop_staged(rows)
    # a row for each cell: at most as many as pivots
    cells = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).collect()
    blocks = plan_blocks(p, {r.cell: r.n for r in cells}, min(block_rows, -(-n // LEAST_BLOCKS)))
    radius, rows_of = {r.cell: r.radius for r in cells}, {}
    for r in cells:
        first, parts = blocks[r.cell]
        for b in range(first, first + parts):
            rows_of[b] = rows_of.get(b, 0) + r.n // parts
    plan = df.sparkSession.createDataFrame([(c, *v) for c, v in blocks.items()], "p_cell int, first int, parts int")
    placed = stage(dealt.join(F.broadcast(plan), F.col("cell") == F.col("p_cell")).select("vec_id", "is_query", "v", "rid", (F.col("first") + F.pmod(F.xxhash64("rid"), "parts")).cast("int").alias("block")), "blocks")
    drop_staged(dealt)
    queries = placed.where("is_query").select("block", "rid", "vec_id", "v")
    schema = f"q_rid long, query_id {id_type}, rid long, vec_id {id_type}, score long"
    own = _units(placed.select("block", "rid", "vec_id", "v"), queries, group_queries).groupBy("block", "split").applyInArrow(_solve(k, dim), schema)
    own = stage(own, "own-block")
    floors = own.groupBy("q_rid").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    asking = queries.join(floors, queries.rid == floors.q_rid, "left").select("rid", "vec_id", "v", "block", "floor")
    order = sorted(blocks)
    centre, reach = p[order], np.array([radius[c] for c in order])
    first, parts = (np.array([blocks[c][i] for c in order], np.int64) for i in (0, 1))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                y, visits = matrix(part.column("v").to_pylist(), dim), []
                with np.errstate(over="ignore", invalid="ignore"):
                    norm = np.linalg.norm(y, axis=1)
                    # huge components may overflow; a bound that isn't a number excludes nothing
                    most = y @ centre.T + norm[:, None] * reach[None, :]
                    most += 1e-9 * (np.abs(most) + norm[:, None] * np.linalg.norm(centre, axis=1)[None, :]) + 1e-6
                for i, (floor, home) in enumerate(zip(part.column("floor").to_pylist(), part.column("block").to_pylist())):
                    go = np.ones(len(order), bool) if floor is None else ~(most[i] < floor)
                    to = np.unique(np.concatenate([np.arange(f, f + m) for f, m in zip(first[go], parts[go])] or [np.empty(0, np.int64)]))
                    visits.append(to[to != home].astype(np.int32))
                of = pa.array(np.repeat(np.arange(len(visits)), [len(v) for v in visits]))
                to = pa.array(np.concatenate(visits), pa.int32())
                yield pa.RecordBatch.from_arrays([to, *(part.column(c).take(of) for c in ("rid", "vec_id", "v"))], names=["block", "rid", "vec_id", "v"])

    further = stage(asking.mapInArrow(needed, f"block int, rid long, vec_id {id_type}, v binary"), "visits")
    others = _units(placed.select("block", "rid", "vec_id", "v"), further, group_queries).groupBy("block", "split").applyInArrow(_solve(k, dim), schema)
    sizes = df.sparkSession.createDataFrame(list(rows_of.items()), "n_block int, rows long")
    visits = queries.select("block", "rid").union(further.select("block", "rid")).join(F.broadcast(sizes), F.col("block") == F.col("n_block")).select("rid", "block", "rows")
    return own.union(others), visits


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, **params) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k rows with the highest inner products of integer vectors.

    A query's own row takes no part, other rows with the same id or vector do; equal scores go to the smaller id
    (nulls last). Ids may be of any type that has an order. With fewer rows than k all are returned; an empty table gives an
    empty result. Vectors of unequal length are padded with zeros, long ones are read whole. Only id, vector and the query
    condition are read, so other columns can't clash. params are those of `search`.
    """
    found = search(df, is_query, id_col, vec_col, k, **params)
    if found is None:
        id_type = df.select(F.col(id_col)).schema[0].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score long")
    rank = F.row_number().over(W.partitionBy("q_rid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "rid"))
    return found[0].withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
