"""Pages of PDF files that hold one embedded image each: the image as it is stored, in page order.

Files that need drawing (several images on a page, none, small ones, other codings) give one row with a reason; those go to the
recognizer's own rasterizer. Files are rows, each read within one task.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Pixels that an image has at least in each direction.
LEAST = 400
#: How deep a page tree may be.
DEEPEST = 64
TOKEN = re.compile(rb"\s*(?:%[^\r\n]*\s*)*(<<|>>|\[|\]|/[^\s<>\[\]()/%{}]*|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|[^\s<>\[\]()/%{}]+)", re.S)
STREAM = re.compile(rb"\s*stream\r?\n")
OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b")


class Ref(int):
    """The number of an object that is referred to."""


def value(data: bytes, at: int) -> tuple[object, int]:
    """The value that begins at a place, and where it ends: dict, list, Ref, number, or bytes for names and all else."""
    def word(at: int) -> tuple[bytes, int]:
        m = TOKEN.match(data, at)
        if not m:
            raise ValueError(f"no value at {at}")
        return m[1], m.end()

    t, end = word(at)
    if t in (b"<<", b"["):
        items, close = [], b">>" if t == b"<<" else b"]"
        while word(end)[0] != close:
            item, end = value(data, end)
            if item == b"R" and len(items) >= 2:  # a reference: number, generation, R
                item = Ref(items[-2])
                del items[-2:]
            items.append(item)
        end = word(end)[1]
        return (dict(zip(items[::2], items[1::2])) if t == b"<<" else items), end
    return (int(t) if re.fullmatch(rb"[+-]?\d+", t) else t), end


class File:
    """Objects of a file by number; later ones replace earlier ones, as updates are appended."""

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ValueError("not a PDF file")
        self.data, self.at, self.packed, at = data, {}, {}, 0
        while m := OBJECT.search(data, at):  # what lies within streams is passed over
            self.at[int(m[1])] = at = m.end()
            try:
                head, end = value(data, at)
            except ValueError:
                continue
            if isinstance(head, dict) and (s := STREAM.match(data, end)):
                at = s.end() + len(self.body(head.get(b"/Length"), s.end()))
        if re.search(rb"/Encrypt\b", data):
            raise ValueError("encrypted")
        for n in list(self.at):
            head = self.get(Ref(n))
            if isinstance(head, dict) and head.get(b"/Type") == b"/ObjStm":
                body = self.stream(Ref(n))
                numbers = [int(x) for x in body[: self.get(head[b"/First"])].split()]
                self.packed |= {k: value(body, self.get(head[b"/First"]) + at)[0] for k, at in zip(numbers[::2], numbers[1::2]) if k not in self.at}

    def get(self, x: object) -> object:
        """What a reference stands for; other values are themselves."""
        for _ in range(DEEPEST):
            if not isinstance(x, Ref):
                return x
            x = value(self.data, self.at[x])[0] if x in self.at else self.packed.get(x)
        raise ValueError("references in a circle")

    def raw(self, ref: Ref) -> bytes:
        head, end = value(self.data, self.at[ref])
        if not (s := STREAM.match(self.data, end)):
            raise ValueError("no stream")
        return self.body(self.get(head.get(b"/Length")), s.end())

    def body(self, size: object, start: int) -> bytes:
        """A stream's bytes, of that size if the stream ends there, else up to the next end."""
        if isinstance(size, int) and not isinstance(size, Ref) and self.data[start + size : start + size + 20].lstrip().startswith(b"endstream"):
            return self.data[start : start + size]
        end = self.data.find(b"endstream", start)
        if end < 0:
            raise ValueError("a stream without an end")
        return re.sub(rb"\r?\n$", b"", self.data[start:end])

    def stream(self, ref: Ref) -> bytes:
        """The stream's data, if it is coded by Flate alone, or not at all."""
        coding = self.coding(self.get(ref))
        if coding not in ([], [b"/FlateDecode"]):
            raise ValueError("stream coded by " + b" ".join(coding).decode())
        return zlib.decompressobj().decompress(self.raw(ref)) if coding else self.raw(ref)

    def coding(self, head: dict) -> list[bytes]:
        f = self.get(head.get(b"/Filter"))
        return [] if f is None else f if isinstance(f, list) else [f]

    def pages(self) -> Iterator[dict]:
        roots = [d for n in [*self.at, *self.packed] if isinstance(d := self.get(Ref(n)), dict) and d.get(b"/Type") == b"/Catalog"]
        if not roots:
            raise ValueError("no page tree")
        todo = [(roots[-1].get(b"/Pages"), {}, 0)]
        while todo:
            ref, above, depth = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or depth > DEEPEST:
                raise ValueError("broken page tree")
            node = above | node  # resources pass down
            if b"/Kids" in node and node.get(b"/Type") != b"/Page":
                below = {k: v for k, v in node.items() if k == b"/Resources"}
                todo += [(k, below, depth + 1) for k in reversed(self.get(node[b"/Kids"]))]
            else:
                yield node

    def image(self, page: dict) -> tuple[str, int, int, bytes]:
        """Format, width, height and file of the one image of a page."""
        objects = self.get((self.get(page.get(b"/Resources")) or {}).get(b"/XObject")) or {}
        refs = [r for r in objects.values() if (self.get(r) or {}).get(b"/Subtype") == b"/Image"]
        if len(refs) != 1:
            raise ValueError(f"{len(refs)} images on a page")
        head = self.get(refs[0])
        width, height, coding = self.get(head[b"/Width"]), self.get(head[b"/Height"]), self.coding(head)
        if width < LEAST or height < LEAST:
            raise ValueError("a small image")
        if coding == [b"/DCTDecode"]:
            return "jpeg", width, height, self.raw(refs[0])
        depth, space, extra = self.get(head.get(b"/BitsPerComponent")), self.get(head.get(b"/ColorSpace")), self.get(head.get(b"/DecodeParms")) or {}
        colors = {b"/DeviceGray": 1, b"/DeviceRGB": 3}.get(space if isinstance(space, bytes) else None)
        if depth != 8 or colors is None:
            raise ValueError("colours of another kind")
        pixels, row = self.stream(refs[0]), width * colors
        if not (isinstance(extra, dict) and self.get(extra.get(b"/Predictor", 1)) >= 10):  # with it, rows already begin with their PNG filter
            pixels = b"".join(b"\0" + pixels[y * row : (y + 1) * row] for y in range(height))
        if len(pixels) != height * (row + 1):
            raise ValueError("an image of another size")
        return "png", width, height, png(width, height, colors, pixels)


def png(width: int, height: int, colors: int, rows: bytes) -> bytes:
    """A PNG file of rows that begin with their filter."""
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2 if colors == 3 else 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows, 1)) + part(b"IEND", b"")


def split_pdf(files: DataFrame) -> DataFrame:
    """files (job_id, file_name, file) as (job_id, file_name, page_num, format, width, height, image, reason).

    A row for each page in order, if every page has exactly one image of LEAST pixels or more each way, stored as JPEG or as
    8-bit gray or RGB pixels (given as PNG). Else one row for the file with its reason and no page. A null or broken file has a
    reason too; no file fails the job. A file without pages has the reason that it has none. Repeated rows repeat; an empty table stays empty.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for job, name, file in zip(pdf.job_id, pdf.file_name, pdf.file):
                try:
                    f = File(bytes(file))
                    rows = [(job, name, n, *f.image(p), None) for n, p in enumerate(f.pages())]
                    if not rows:
                        raise ValueError("no pages")
                except Exception as e:
                    rows = [(job, name, None, None, None, None, None, str(e) if isinstance(e, ValueError) else f"{type(e).__name__}: {e}")]
                out = pd.DataFrame(rows, columns=["job_id", "file_name", "page_num", "format", "width", "height", "image", "reason"])
                yield out.astype({k: "Int32" for k in ("page_num", "width", "height")})

    return files.select("job_id", "file_name", "file").mapInPandas(run, "job_id string, file_name string, page_num int, format string, width int, height int, image binary, reason string")
