"""Lines, boxes and bands from recognized words."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def blank_overtaken(words: DataFrame, page: list[str], order: str = "idx") -> DataFrame:
    """words with text blanked where the next word stands higher."""
    nxt = F.lead("top").over(W.partitionBy(*page).orderBy(order))
    return words.withColumn("text", F.when(F.coalesce(nxt < F.col("top"), F.lit(False)), F.lit("")).otherwise(F.col("text")))


def build_lines(words: DataFrame, page: list[str], limit: int, gap: int, order: str = "idx") -> DataFrame:
    """(page, line, y, text): words left of limit and longer than one character, put into lines; a word more than `gap` below
    the kept word before it starts a new one."""
    kept = blank_overtaken(words, page, order).where((F.col("left") < limit) & (F.length("text") > 1))
    w = W.partitionBy(*page).orderBy(order)
    new = F.coalesce((F.col("top") - F.lag("top").over(w) > gap).cast("int"), F.lit(0))
    lines = kept.withColumn("_new", new).withColumn("line", F.sum("_new").over(w).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "text")))
    return lines.groupBy(*page, "line").agg(F.min("top").alias("y"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def union_box(boxes: DataFrame, key: list[str]) -> DataFrame:
    """The smallest box (x, y, w, h) around a key's boxes."""
    right, low = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    return boxes.groupBy(*key).agg(F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("w"), (low - F.min("y")).alias("h"))


def zone_box(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """True for boxes that may hold the machine-readable zone: low on the page, flat, and over half as wide."""
    return (y > page_h / 2) & (w / h > 5) & (w / page_w > 0.5)


def category_box(w: Column, h: Column) -> Column:
    """True for boxes the size of a licence category's cell."""
    return (w * h).between(800, 3100) & (w / h).between(0.4, 3.0)


# Expected places of licence fields below and right of the anchor, and the x window of each.
BANDS = (("fam_rus", 0, 0, 300), ("fam_eng", 25, 0, 300), ("name_rus", 58, 0, 300), ("name_eng", 84, 0, 300), ("p3", 141, 0, 100), ("birthplace_rus", 170, 0, 300), ("p4a", 235, -20, 20), ("p4b", 235, 214, 294), ("p5", 331, 0, 100))


def assign_band(x: Column, y: Column, x0: Column, y0: Column) -> Column:
    """The first field whose expected place is within 17 rows and whose window holds x; null if none."""
    out = None
    for name, dy, lo, hi in BANDS:
        here = (F.abs(y - y0 - dy) < 17) & (x - x0 >= lo) & (x - x0 < hi)
        out = F.when(here, name) if out is None else out.when(here, name)
    return out


Box = tuple[int, int, int, int]
#: Pages whose boxes are put into lines before they are passed on.
PAGES = 500


def cluster(boxes: list[Box]) -> list[list[Box]]:
    """Boxes (x, y, w, h) in lines: a box joins the first line whose centre lies within its height, and moves that centre half
    the way to its own; lines from the top, boxes in order within each."""
    lines: list[list[Box]] = []
    centres: list[tuple[float, int]] = []  # in order, with the line's number: by it, lines that a box may join are found
    for box in boxes:
        _, y, _, h = box
        mid = y + h / 2
        lo, hi = bisect_right(centres, (y, len(lines))), bisect_left(centres, (y + h, -1))
        if lo < hi:
            at = min(range(lo, hi), key=lambda i: centres[i][1])
            centre, k = centres.pop(at)
            lines[k].append(box)
            insort(centres, ((centre + mid) / 2, k))
        else:
            insort(centres, (mid, len(lines)))
            lines.append([box])
    return [sorted(lines[k]) for _, k in centres]


def joined(line: list[Box], ws: float, hs: float) -> list[Box]:
    """A line's boxes with neighbours made one that overlap or lie less than 2 ws apart, if their heights differ by less than hs.
    The height of a joined box is the sum of both over 1.9."""
    out: list[Box] = []
    for x, y, w, h in line:
        if out:
            px, py, pw, ph = out[-1]
            overlap = px + pw - x
            if (overlap > 0 or -overlap < 2 * ws) and abs(ph - h) < hs:
                out[-1] = (px, min(py, y), max(pw, x + w - px) if overlap > 0 else x + w - px, round((ph + h) / 1.9))
                continue
        out.append((x, y, w, h))
    return out


def cluster_lines(boxes: DataFrame, page: list[str], ws: float, hs: float) -> DataFrame:
    """(page, line, pos, x, y, w, h): the boxes of each page in lines, with close neighbours joined. Greedy in the order of
    idx, so a page is one list, put together by Spark; Python gets batches of pages. Boxes of equal idx go by place, a null idx is last."""
    kinds = {f.name: f.dataType.simpleString() for f in boxes.schema.fields}
    names = ["x", "y", "w", "h"]

    boxes_in = F.array_sort(F.collect_list(F.struct(F.col("idx").isNull().alias("none"), "idx", *names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = b.column(b.num_columns - 1)
            at, ends = parts.flatten(), np.cumsum(pc.list_value_length(parts).to_numpy()).tolist()
            each = list(zip(*(at.field(n).to_pylist() for n in names)))
            for first in range(0, b.num_rows, PAGES):  # what a few pages give is passed on at once
                some = range(first, min(first + PAGES, b.num_rows))
                rows = [(k, *box, n, p) for k in some for n, line in enumerate(cluster(each[ends[k - 1] if k else 0 : ends[k]])) for p, box in enumerate(joined(line, ws, hs))]
                of, *values = zip(*rows)
                of = pa.array(of, pa.int64())
                own = [b.column(i).take(of) for i in range(len(page))]
                kind = [*(at.type.field(n).type for n in names), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(v, t) for v, t in zip(values, kind))], names=[*page, *names, "line", "pos"])

    pages = boxes.groupBy(*page).agg(boxes_in.alias("__boxes"))
    return pages.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in [*page, *names]) + ", line int, pos int")


def bottom_page(lines: DataFrame, page: list[str]) -> DataFrame:
    """Fields of the lower passport page from its lines, by bands of y: surname above 118, given name above 250, patronymic
    above 327, then the line with the birth date and gender, and the birth place from 365 to 395."""
    from paperloom.functions.dates import find_date
    from paperloom.functions.text import digits_to_russian, line_gender

    l = lines.withColumn("d", find_date(F.col("text"))).withColumn("full", F.coalesce(F.length("d") == 10, F.lit(False)))  # noqa: E741
    clean = lambda c: F.trim(F.regexp_replace(digits_to_russian(c), "[. —-]", ""))
    first = lambda v, cond: F.min_by(v, F.when(cond, F.col("line")))
    joined = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("line", "text")))), lambda x: x["text"]), " ")
    y, in_low = F.col("y"), F.col("y").between(327, 394)
    dated = in_low & F.col("full")
    null = lambda c: F.when(c != "", c)
    return l.groupBy(*page).agg(
        null(clean(joined(y < 118))).alias("F"), null(clean(first(F.col("text"), y.between(118, 249)))).alias("I"), null(clean(first(F.col("text"), y.between(250, 326) & ~F.col("full")))).alias("O"),
        first(F.col("d"), dated).alias("birth_date"), first(line_gender(F.col("text")), dated).alias("gender"), null(joined(y.between(366, 394) & ~F.col("full"))).alias("birth_place"),
    )
