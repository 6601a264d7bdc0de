"""Small PDF files as inputs of queries and tests."""

import zlib


def stream(head, body):
    return b"<< " + head + b" /Length %d >>\nstream\n" % len(body) + body + b"\nendstream"


def gray(width, height, level, extra=b"/DeviceGray", predictor=False):
    rows = bytes([level]) * width * height if not predictor else (b"\1" + bytes([level]) + bytes(width - 1)) * height
    parms = b"/DecodeParms << /Predictor 15 /Colors 1 /BitsPerComponent 8 /Columns %d >> " % width if predictor else b""
    return stream(b"/Type /XObject /Subtype /Image /Width %d /Height %d /BitsPerComponent 8 /ColorSpace %s /Filter /FlateDecode %s" % (width, height, extra, parms), zlib.compress(rows))


def jpeg(width, height, body):
    return stream(b"/Type /XObject /Subtype /Image /Width %d /Height %d /BitsPerComponent 8 /ColorSpace /DeviceRGB /Filter [/DCTDecode]" % (width, height), body)


def document(pages, packed=False, nested=False):
    """pages: a list of images for each page. packed: page objects lie in an object stream; nested: the tree has two levels."""
    objects, kids = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}, []
    for images in pages:
        at = len(objects) + 10
        names = b" ".join(b"/Im%d %d 0 R" % (k, at + 1 + k) for k in range(len(images)))
        objects[at] = b"<< /Type /Page /Parent 2 0 R /Resources << /XObject << %s >> >> /Note (a \\) b (c) d) >>" % names
        objects |= {at + 1 + k: image for k, image in enumerate(images)}
        kids.append(at)
    refs = lambda xs: b" ".join(b"%d 0 R" % x for x in xs)
    if nested and len(kids) > 1:
        objects[3], objects[4] = (b"<< /Type /Pages /Parent 2 0 R /Kids [%s] /Count 1 >>" % refs(x) for x in (kids[:1], kids[1:]))
        kids_of_root = [3, 4]
    else:
        kids_of_root = kids
    objects[2] = b"<< /Type /Pages /Kids [ %s ] /Count %d >>" % (refs(kids_of_root), len(kids))
    if packed:
        moved = {n: o for n, o in objects.items() if not o.endswith(b"endstream")}
        body = b"\n".join(moved.values())
        places = [sum(len(o) + 1 for o in list(moved.values())[:k]) for k in range(len(moved))]
        head = b" ".join(b"%d %d" % x for x in zip(moved, places)) + b"\n"
        objects = {n: o for n, o in objects.items() if n not in moved} | {900: stream(b"/Type /ObjStm /N %d /First %d /Filter /FlateDecode" % (len(moved), len(head)), zlib.compress(head + body))}
    return b"%PDF-1.5\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % x for x in objects.items()) + b"\ntrailer << /Root 1 0 R >>\n%%EOF"
