"""Matching of binary image descriptors between pages and templates, and the geometric filter of matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A match counts if its distance is below this part of the second nearest one's.
RATIO = 0.71
#: Page descriptors that are compared at once with a template's.
TILE = 256
#: Matches that the filter works on at most, triangles that it tries, relative differences that it allows, and how far from a line corners are.
MOST, TRIES, SCALE, FLAT = 100, 2000, 0.01, 0.2
MATCHES = "array<struct<page_kp int, template_kp int, distance int, x float, y float, to_x float, to_y float>>"
POINTS = "array<struct<kp int, x float, y float, desc binary>>"


def packed(descs: list[bytes]) -> np.ndarray:
    """Descriptors of equal length as rows of 64-bit numbers."""
    size = max(map(len, descs), default=0)
    width = -(-size // 8) * 8
    return np.frombuffer(b"".join(bytes(d).ljust(width, b"\0") for d in descs), np.uint64).reshape(len(descs), width // 8)


def nearest_two(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of a: the nearest row of b by differing bits (of equals the first), its distance, and the second nearest one's. b has two rows or more."""
    at, first, second = [], [], []
    for i in range(0, len(a), TILE):
        d = np.bitwise_count(a[i : i + TILE, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int32)
        best = d.argmin(axis=1)
        at.append(best)
        first.append(d[np.arange(len(d)), best])
        d[np.arange(len(d)), best] = np.iinfo(np.int32).max
        second.append(d.min(axis=1))
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (at, first, second))


def _distances(p: np.ndarray, corners: np.ndarray) -> np.ndarray:
    return np.hypot(*(p[:, None, :] - corners[None, :, :]).transpose(2, 0, 1))


def consistent(src: np.ndarray, dst: np.ndarray, seed: int = 1, tries: int = TRIES) -> np.ndarray:
    """Which matches keep one scale: a triangle of matches is drawn, many times; those whose sides have shrunk alike and whose
    corners aren't in line vote for all matches whose distances to the corners have shrunk by the same factor. The most votes win."""
    n = len(src)
    best = np.zeros(n, bool)
    if n < 3:
        return best
    rng = np.random.default_rng(seed)
    for _ in range(tries):
        t = rng.choice(n, 3, replace=False)
        a, b = _distances(src[t], src[t])[[0, 1, 2], [1, 2, 0]], _distances(dst[t], dst[t])[[0, 1, 2], [1, 2, 0]]
        if not (a.all() and b.all()):
            continue
        scale = (a / b).mean()
        (x1, y1), (x2, y2) = src[t[1]] - src[t[0]], src[t[2]] - src[t[0]]
        if np.abs(a / b - scale).max() > SCALE * scale or abs(x1 * y2 - x2 * y1) < FLAT * a[0] * a[2]:
            continue
        own, other = _distances(src, src[t]), _distances(dst, dst[t])
        votes = (np.abs(own - scale * other) <= SCALE * scale * np.maximum(other, 1)).all(axis=1)
        if votes.sum() > best.sum():
            best = votes
    return best


def match(page_points: DataFrame, template_points: DataFrame, pairs: DataFrame, ratio: float = RATIO, filtered: bool = True) -> DataFrame:
    """pairs (page_id, template) with n and matches: for each descriptor of a page its nearest one of the template, if the second
    nearest is clearly farther; then, for 3 to MOST matches, those that keep one scale.

    Points are (page_id, kp, x, y, desc) and (template, kp, x, y, desc); kp orders them. A page's and a template's points
    meet in one row, as many as an image has. n is 0 and matches empty where a page or template has under two points, or is unknown. Points without
    a descriptor or number take no part. Pairs are matched once each, repeated ones alike.
    """
    points = lambda df, key: df.where("kp is not null and desc is not null").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("kp", "x", "y", "desc"))).cast(POINTS).alias(f"{key}_points"))
    pages, templates = points(page_points, "page_id"), points(template_points, "template")
    wanted = pairs.select("page_id", "template").distinct()
    met = wanted.join(pages, "page_id", "left").join(templates, "template", "left").select("page_id", "template", "page_id_points", "template_points")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, template, p, t in batch.itertuples(index=False):
                found = []
                if p is not None and t is not None and len(p) >= 2 and len(t) >= 2:
                    at, first, second = nearest_two(packed([x["desc"] for x in p]), packed([x["desc"] for x in t]))
                    good = np.flatnonzero(first < ratio * second)
                    if filtered and 3 <= len(good) <= MOST:
                        place = lambda rows: np.array([(r["x"], r["y"]) for r in rows], np.float64).reshape(-1, 2)
                        good = good[consistent(place([p[i] for i in good]), place([t[at[i]] for i in good]))]
                    found = [(p[i]["kp"], t[at[i]]["kp"], int(first[i]), p[i]["x"], p[i]["y"], t[at[i]]["x"], t[at[i]]["y"]) for i in good.tolist()]
                names = ("page_kp", "template_kp", "distance", "x", "y", "to_x", "to_y")
                out.append((page, template, len(found), [dict(zip(names, m)) for m in found]))
            yield pd.DataFrame(out, columns=["page_id", "template", "n", "matches"])

    kinds = f"page_id {met.schema['page_id'].dataType.simpleString()}, template {met.schema['template'].dataType.simpleString()}"
    return met.mapInPandas(run, f"{kinds}, n int, matches {MATCHES}")
