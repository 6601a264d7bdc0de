"""The boundary to pixel-level recognition, which stays outside: an interface that yields rows for a page image.

Recognizers run inside Python workers, one instance for each; an error becomes a row with qc 4, never a failed task. A call that
takes longer than its deadline has no answer; it is left alone with its instance, and later calls go to a new one.
"""

from __future__ import annotations

import queue
import re
import threading
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Recognizer(Protocol):
    def split(self, file: bytes, name: str) -> list[bytes]: ...

    def text(self, page: bytes, turn: int) -> str: ...

    def barcodes(self, page: bytes, angle: float) -> list[tuple[str, str]]: ...

    def classify(self, page: bytes) -> list[float]: ...

    def written(self, pieces: list[bytes]) -> list[bool]: ...


#: Fixed value: seconds that a call may take.
DEADLINE = 60.0


class _Caller:
    """A thread that makes one call after the other."""

    def __init__(self):
        self.todo, self.done = queue.SimpleQueue(), queue.SimpleQueue()
        threading.Thread(target=self._run, daemon=True).start()

    def _run(self) -> None:
        while (job := self.todo.get()) is not None:
            call, args = job
            try:
                self.done.put((call(*args), None))
            except Exception as e:
                self.done.put((None, e))


#: Threads of this process that wait for a call; most calls are far shorter than it takes to start one.
_IDLE: list[_Caller] = []


def within(seconds: float, call: Callable, *args: object) -> object:
    """What the call gives or raises; TimeoutError if it takes longer than that. The call itself can't be stopped and runs on."""
    try:
        caller = _IDLE.pop()
    except IndexError:
        caller = _Caller()
    caller.todo.put((call, args))
    try:
        answer, error = caller.done.get(timeout=seconds)
    except queue.Empty:
        caller.todo.put(None)  # it ends after its late call
        raise TimeoutError(f"no answer in {seconds:g} s") from None
    _IDLE.append(caller)
    if error is not None:
        raise error
    return answer


class FixtureRecognizer:
    """Reads what it would recognize from the file's own text: pages parted by form feeds, barcodes after '#', with an angle
    after '@' where they can be read at that angle only."""

    def split(self, file: bytes, name: str) -> list[bytes]:
        return file.split(b"\f") if name.lower().endswith(".pdf") else [file]

    def text(self, page: bytes, turn: int) -> str:
        return page.decode() if turn == 0 else ""

    def barcodes(self, page: bytes, angle: float) -> list[tuple[str, str]]:
        codes = [w[1:].partition("@") for w in page.decode().split() if w.startswith("#")]
        return [("I25", code) for code, _, at in codes if float(at or 0) == angle]

    def classify(self, page: bytes) -> list[float]:
        return [float(len(page) % 5 == k) for k in range(5)]

    def written(self, pieces: list[bytes]) -> list[bool]:
        return [re.search(rb"[0-9]", p) is not None for p in pieces]


def recognize(files: DataFrame, make: Callable[[], Recognizer], seconds: float = DEADLINE) -> DataFrame:
    """files (job_id, file_name, file) as pages: job_id, page_num, text, barcodes, logits, qc, exception, late. What a page's call doesn't
    give in time is null and named in late (null if all came); a file that isn't split in time is one row with qc 4."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = make()
        for pdf in batches:
            out = []
            for job, name, file in zip(pdf.job_id, pdf.file_name, pdf.file):
                try:
                    pages = within(seconds, r.split, bytes(file), name)
                except Exception as e:
                    out.append((job, 0, None, None, None, 4, f"{type(e).__name__}: {e}", None))
                    r = make() if isinstance(e, TimeoutError) else r
                    continue
                for n, page in enumerate(pages):
                    got: dict[str, object] = {}
                    late: list[str] = []
                    try:
                        for kind, args in (("text", (0,)), ("barcodes", (0.0,)), ("classify", ())):
                            try:
                                got[kind] = within(seconds, getattr(r, kind), page, *args)
                            except TimeoutError:
                                late.append(kind)
                                r = make()
                        codes = got.get("barcodes")
                        out.append((job, n, got.get("text"), None if codes is None else [d for _, d in codes], got.get("classify"), None, None, late or None))
                    except Exception as e:
                        out.append((job, n, None, None, None, 4, f"{type(e).__name__}: {e}", late or None))
            yield pd.DataFrame(out, columns=["job_id", "page_num", "text", "barcodes", "logits", "qc", "exception", "late"])

    return files.select("job_id", "file_name", "file").mapInPandas(run, "job_id string, page_num int, text string, barcodes array<string>, logits array<double>, qc int, exception string, late array<string>")


def written(rectangles: DataFrame, key: str, make: Callable[[], Recognizer], seconds: float = DEADLINE) -> DataFrame:
    """rectangles (key, pieces) as (key, answers): whether each piece is written on. One answer, false, where none comes in time or the
    call fails; null for null `pieces`, none for none. Single null pieces are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = make()
        for pdf in batches:
            out = []
            for pieces in pdf.pieces:
                try:
                    out.append(None if pieces is None else within(seconds, r.written, [bytes(p) for p in pieces if p is not None]) if len(pieces) else [])
                except Exception as e:
                    out.append([False])
                    r = make() if isinstance(e, TimeoutError) else r
            yield pd.DataFrame({key: pdf[key], "answers": pd.Series(out, index=pdf.index, dtype=object)})

    return rectangles.select(key, "pieces").mapInPandas(run, f"{key} {rectangles.schema[key].dataType.simpleString()}, answers array<boolean>")


def quarter_turns(image: np.ndarray, n: int) -> np.ndarray:
    """The image turned left n quarters."""
    return np.rot90(image, n)


def otsu(gray: np.ndarray) -> int:
    """The threshold that parts a gray image's values best."""
    hist = np.bincount(gray.ravel(), minlength=256).astype(float)
    below, weight = np.cumsum(hist), np.cumsum(hist * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (weight / below - (weight[-1] - weight) / above) ** 2
    return int(np.nan_to_num(between).argmax())


def dark_box(gray: np.ndarray) -> tuple[int, int, int, int] | None:
    """The box (x, y, w, h) around what is darker than the threshold."""
    ys, xs = np.nonzero(gray <= otsu(gray))
    return (int(xs.min()), int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1) if len(xs) else None


def page_kernels(images: DataFrame) -> DataFrame:
    """images (origin, height, width, nChannels, data) with the dark box of the gray page, and of the page turned once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for o, h, w, c, d in zip(pdf.origin, pdf.height, pdf.width, pdf.nChannels, pdf.data):
                g = np.frombuffer(bytes(d), np.uint8).reshape(h, w, c).mean(axis=2).astype(np.uint8)
                for turn in (0, 1):
                    rows.append((o, turn, otsu(g), list(dark_box(quarter_turns(g, turn)) or [])))
            yield pd.DataFrame(rows, columns=["origin", "turn", "threshold", "box"])

    return images.where("height > 0").select("origin", "height", "width", "nChannels", "data").mapInPandas(run, "origin string, turn int, threshold int, box array<int>")
