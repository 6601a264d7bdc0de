"""PDF files of one image a page, of other kinds, and broken ones."""

import struct
import zlib

from paperloom.plans.pdf_inputs import document, gray, jpeg
from paperloom.sources.pdf import split_pdf

SCHEMA = "job_id string, file_name string, file binary, page_num string"


def pixels(png):
    """Width, height and pixel bytes of a gray PNG without filters or with the first one."""
    at, data, size = 8, b"", None
    while at < len(png):
        n, kind = struct.unpack(">I", png[at : at + 4])[0], png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + n]
        assert struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    rows, (width, height), out = zlib.decompress(data), size, b""
    for y in range(height):
        kind, row = rows[y * (width + 1)], bytearray(rows[y * (width + 1) + 1 : (y + 1) * (width + 1)])
        if kind == 1:
            for x in range(1, width):
                row[x] = (row[x] + row[x - 1]) % 256
        out += bytes(row)
    return width, height, out


def test_pages_in_order(spark):
    pages = [[gray(400, 410, 7)], [jpeg(500, 600, b"\xff\xd8 endstrea 1 0 obj \xff\xd9")], [gray(401, 400, 9, predictor=True)]]
    rows = [(str(k), "a.pdf", document(pages, packed=k & 1, nested=k & 2), "clash") for k in range(4)]
    got = {}
    for r in split_pdf(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.job_id, []).append(r)
    assert sorted(got) == list("0123")
    for out in got.values():
        out.sort(key=lambda r: r.page_num)
        assert [(r.page_num, r.format, r.width, r.height, r.reason) for r in out] == [(0, "png", 400, 410, None), (1, "jpeg", 500, 600, None), (2, "png", 401, 400, None)]
        assert pixels(bytes(out[0].image)) == (400, 410, b"\7" * 400 * 410) and pixels(bytes(out[2].image)) == (401, 400, b"\t" * 401 * 400)
        assert bytes(out[1].image) == b"\xff\xd8 endstrea 1 0 obj \xff\xd9"


def test_reasons(spark):
    one = gray(400, 400, 1)
    whole = document([[one]])
    files = {
        "two": (document([[one], [one, one]]), "2 images on a page"), "none": (document([[]]), "0 images on a page"), "small": (document([[one], [gray(399, 400, 1)]]), "a small image"),
        "colour": (document([[gray(400, 400, 1, extra=b"/DeviceCMYK")]]), "colours of another kind"), "text": (b"hello", "not a PDF file"), "empty": (b"", "not a PDF file"), "no pages": (document([]), "no pages"),
        "encrypted": (whole + b" /Encrypt 5 0 R", "encrypted"), "no root": (b"%PDF-1.4 1 0 obj << >> endobj", "no page tree"), "circle": (b"%PDF-1.4 1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj 2 0 R endobj", "broken page tree"),
    }
    rows = [(n, "x.pdf", f, "") for n, (f, _) in files.items()] + [("null", None, None, None), ("cut", "x.pdf", whole[: len(whole) // 2], "")]
    got = {r.job_id: r for r in split_pdf(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows) and all(r.page_num is None and r.image is None and r.reason for r in got.values())
    assert {n: got[n].reason for n in files} == {n: reason for n, (_, reason) in files.items()}


def test_update_replaces_object(spark):
    """An appended object of the same number counts; an empty table stays empty."""
    file = document([[gray(400, 400, 1)]])
    number = int(file.split(b"/Im0 ")[1].split()[0])
    file += b"\n%d 0 obj\n" % number + gray(400, 400, 5) + b"\nendobj"
    r = split_pdf(spark.createDataFrame([("1", "a.pdf", file, "")], SCHEMA)).first()
    assert pixels(bytes(r.image))[2] == b"\5" * 160_000
    assert split_pdf(spark.createDataFrame([], SCHEMA)).count() == 0
