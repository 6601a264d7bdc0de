"""Ranked lexical search: windowed bucket scoring over postings.

One pass cuts every document into terms and writes the postings of the asked terms, window by window: a window is a
fixed number of documents, one row that holds their ids, lengths and postings. Sums over these rows give the corpus
statistics. A second pass reads the windows: impacts are computed once a posting, then each item's terms are traversed,
their weighted impacts added into an array of the window's size with a bitset of the documents touched, and what can still
enter is put into the item's heap. Each task gives its heaps; the best of those are the result. No posting is shuffled.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.llm.common import stage

#: Documents of a window: an array of their scores takes 64 KB.
WINDOW = 8192
#: Terms of items, counted for each item, that are sent to the workers at once; more items are searched in blocks.
BLOCK_TERMS = 1 << 20
#: Bytes that separate terms become blanks, A-Z become a-z; digits, letters and all bytes beyond ASCII stay.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
POSTINGS = "ids array<bigint>, n binary, terms binary, sizes binary, docs binary, tfs binary"
#: A null id is last among equals.
NO_ID = (1 << 63) - 1


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8, in order."""
    return text.translate(_FOLD).split()


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, term): each term of each item once. Rows of equal id and text are one item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, t in enumerate(b.column(1)):
                if found := sorted(set(terms_of(t.as_buffer().to_pybytes()))):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([at] * len(found))), pa.array(found, pa.binary())], names=["item", "term"])

    rows = items.where(F.col(text).isNotNull()).select(F.col(item_id).alias("item"), F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(cut, f"item {rows.schema['item'].dataType.simpleString()}, term binary").distinct()


def postings(docs: DataFrame, terms: list[bytes], id_col: str, text: str, window: int) -> DataFrame:
    """Windows of documents with at least one term: ids, lengths in terms, and for each of `terms` that occurs its number,
    its count of postings, and these: place in the window and frequency. Numbers are little-endian arrays."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(shared.value)}.get
        ids, lengths, places, found, tfs = [], [], [], [], []

        def flush() -> pa.RecordBatch:
            term, doc, tf = np.array(found, np.int32), np.repeat(np.arange(len(ids), dtype=np.int32), places), np.array(tfs, np.int32)
            order = np.argsort(term, kind="stable")
            some, sizes = np.unique(term, return_counts=True)
            data = [np.array(lengths, np.int64), some.astype(np.int32), sizes.astype(np.int32), doc[order], tf[order]]
            out = pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in data)], names=["ids", "n", "terms", "sizes", "docs", "tfs"])
            for x in (ids, lengths, places, found, tfs):
                x.clear()
            return out

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                if cut := terms_of(t.as_buffer().to_pybytes()):
                    counts = Counter(map(number, cut))
                    counts.pop(None, None)
                    ids.append(i)
                    lengths.append(len(cut))
                    places.append(len(counts))
                    found.extend(counts.keys())
                    tfs.extend(counts.values())
                    if len(ids) == window:
                        yield flush()
        if ids:
            yield flush()

    rows = docs.where(F.col(text).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(run, POSTINGS)


class Heap:
    """The k best (score, id) of an item: highest scores, of equal ones the smallest ids."""

    def __init__(self, k: int):
        self.k, self.best = k, []

    def least(self) -> int:
        """The least score that may enter."""
        return self.best[0][0] if len(self.best) == self.k else 1

    def offer(self, score: int, doc: int) -> None:
        if len(self.best) < self.k:
            heapq.heappush(self.best, (score, -doc))
        elif (score, -doc) > self.best[0]:
            heapq.heapreplace(self.best, (score, -doc))


def score_windows(windows: DataFrame, items: list[tuple[int, np.ndarray]], weights: np.ndarray, docs_all: int, terms_all: int, k: int) -> DataFrame:
    """(number, doc, score): of each task the k best documents for each item, by the item's number.

    items: number and numbers of the terms; weights: of each term."""
    shared = windows.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, w = shared.value
        heaps = [Heap(k) for _ in asked]
        for b in batches:
            for row in range(b.num_rows):
                ids = np.array([NO_ID if i is None else i for i in b.column(0)[row].as_py()], np.int64)
                n, terms, sizes, docs, tfs = (np.frombuffer(b.column(c)[row].as_buffer(), kind) for c, kind in zip(range(1, 6), (np.int64, np.int32, np.int32, np.int32, np.int32)))
                m = 20 * (50 + (50 * n * docs_all) // terms_all)
                tf = tfs.astype(np.int64)
                impacts = (1_000_000_000 * tf) // (1000 * tf + m[docs])
                ends = np.cumsum(sizes)
                acc, bitsets = np.zeros(len(ids), np.int64), {}
                for heap, (_, wanted) in zip(heaps, asked):
                    at = np.searchsorted(terms, wanted)
                    at = np.minimum(at, len(terms) - 1)[: len(wanted) if len(terms) else 0]
                    occupied = np.zeros((len(ids) + 7) // 8, np.uint8)
                    for t in at[terms[at] == wanted[: len(at)]].tolist():  # a term's postings name each document once
                        own = docs[ends[t] - sizes[t] : ends[t]]
                        if t not in bitsets:
                            mask = np.zeros(len(ids), bool)
                            mask[own] = True
                            bitsets[t] = np.packbits(mask, bitorder="little")
                        acc[own] += w[terms[t]] * impacts[ends[t] - sizes[t] : ends[t]]
                        occupied |= bitsets[t]
                    touched = np.flatnonzero(np.unpackbits(occupied, count=len(ids), bitorder="little"))
                    scores = acc[touched]
                    least = heap.least()
                    if len(scores) > k:  # fewer than k of the window are above its own k-th score
                        least = max(least, int(np.partition(scores, -k)[-k]))
                    for d in touched[scores >= least].tolist():
                        heap.offer(int(acc[d]), int(ids[d]))
                    acc[touched] = 0
        out = [(number, -doc, score) for heap, (number, _) in zip(heaps, asked) for score, doc in heap.best]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["number", "doc", "score"])

    return windows.mapInArrow(run, "number long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item, rank, doc, score): the k documents of highest score above 0 for each item, equal scores by ascending id.

    Ids of documents are integers; null ids are last among equals. Each row of docs is a document of its own: repeated
    rows all take ranks. Null texts and texts without terms are no documents. Items without terms have no rows; items of
    equal id are one, with the terms of all. All of each text counts. No items or no documents give an empty result.
    Items are searched in blocks whose terms number block_terms on average, so what is sent to workers is bounded (the terms of one item
    have to fit into a task's memory). Columns other than ids and texts are not read, whatever their names.
    """
    spark, kind = docs.sparkSession, items.schema[item_id].dataType.simpleString()
    pairs = stage(item_terms(items, item_id, item_text), "item-terms")
    blocks = -(-pairs.count() // block_terms)
    out = spark.createDataFrame([], f"item {kind}, rank int, doc long, score long")
    for block in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block) if blocks > 1 else pairs
        asked = own.groupBy("item").agg(F.sort_array(F.collect_list("term")).alias("terms")).toArrow()
        if asked.num_rows:
            out = out.union(_search_block(docs, asked, kind, k, id_col, text, window))
    return out.select(F.col("item").alias(item_id), "rank", F.col("doc").alias(id_col), "score")


def _search_block(docs: DataFrame, asked: pa.Table, kind: str, k: int, id_col: str, text: str, window: int) -> DataFrame:
    spark = docs.sparkSession
    lists = asked.column("terms").combine_chunks()
    flat = lists.flatten().dictionary_encode()
    terms, codes = flat.dictionary.to_pylist(), flat.indices.to_numpy()
    starts = np.cumsum([0, *(len(x) for x in lists)])
    items = [(i, np.sort(codes[starts[i] : starts[i + 1]]).astype(np.int32)) for i in range(len(lists))]
    windows = stage(postings(docs, terms, id_col, text, window), "postings")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs_all, terms_all = np.zeros(len(terms), np.int64), 0, 0
        for b in batches:
            for row in range(b.num_rows):
                n, some, sizes = (np.frombuffer(b.column(c)[row].as_buffer(), kind) for c, kind in ((0, np.int64), (1, np.int32), (2, np.int32)))
                df[some] += sizes
                docs_all, terms_all = docs_all + len(n), terms_all + int(n.sum())
        at = np.flatnonzero(df)  # terms, then under -1 and -2 the documents and all their terms
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1, -2], pa.int64()), pa.array([*df[at].tolist(), docs_all, terms_all], pa.int64())], names=["term", "count"])

    sums = windows.select("n", "terms", "sizes").mapInArrow(counted, "term long, count long").groupBy("term").agg(F.sum("count").alias("count"))
    sums = {r.term: r["count"] for r in sums.collect()}  # a row for each term of the block
    docs_all, terms_all = sums.get(-1, 0), sums.get(-2, 0)
    if not docs_all:
        return spark.createDataFrame([], f"item {kind}, rank int, doc long, score long")
    df = np.array([sums.get(t, 0) for t in range(len(terms))], np.float64)
    weights = np.floor(1000 * np.log((2 * docs_all + 2) / (2 * df + 1))).astype(np.int64)
    best = score_windows(windows, items, weights, docs_all, terms_all, k)
    order = W.partitionBy("number").orderBy(F.desc("score"), "doc")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame(pa.table({"i_number": pa.array(range(len(lists)), pa.int64()), "item": asked.column("item").combine_chunks()}))
    named = ranked.join(F.broadcast(names), ranked.number == names.i_number)  # as many rows as the block has items
    return named.select("item", "rank", F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc"), "score")
