"""The search for a readable barcode: which pages are read at which angles, and what they give."""

from pathlib import Path

from paperloom.operators import barcode
from paperloom.operators.rules import RULES
from paperloom.sources.recognize import FixtureRecognizer

KNOWN = sorted({r[3] for r in RULES})


def code(kind, page=1):
    body = f"199{kind:o}9{page:o}9{(kind + page + 1) % 64:o}"
    total = sum(int(d) * (3 if i % 2 == 0 else 1) for i, d in enumerate(body))
    return body + str((10 - total % 10) % 10)


def test_calls_and_results(spark, tmp_path):
    log = Path(tmp_path) / "calls"
    log.mkdir()

    class Counting(FixtureRecognizer):
        def barcodes(self, page, angle):
            with open(log / page.decode().split()[0], "a") as f:
                f.write(f"{angle} ")
            if b"fails" in page:
                raise ValueError("unreadable")
            return super().barcodes(page, angle)

    good, bad, unknown = code(KNOWN[0], 3), code(KNOWN[0])[:-1] + str((int(code(KNOWN[0])[-1]) + 1) % 10), code(7)
    assert 7 not in KNOWN
    last = barcode.SWEEP[-1]
    pages = {
        "at-once": f"#{bad} #{good}", "plus": f"#{good}@4.0", "minus": f"#{good}@-4.0", "sweep-only": f"#{good}@{barcode.SWEEP[2]}", "sweep": f"#{bad}@-4.0 #{good}@{barcode.SWEEP[2]}",
        "last": f"#{bad} #{good}@{last}", "never": f"#{bad}", "none": "text", "unknown": f"#{unknown}", "fails": "fails",
    }
    rows = [(n, (f"{n} {t}").encode()) for n, t in pages.items()]
    got = {r.name: (r.document_type, r.page_number, r.attempts) for r in barcode.search(spark.createDataFrame(rows, "name string, page binary"), ["name"], Counting).collect()}
    hit = (KNOWN[0], 3)
    assert got == {"at-once": (*hit, 1), "plus": (*hit, 2), "minus": (*hit, 3), "sweep-only": (0, None, 3), "sweep": (*hit, 6), "last": (*hit, 29), "never": (0, None, 29), "none": (0, None, 3), "unknown": (0, None, 3), "fails": (0, None, 3)}
    order = [*barcode.FAST, *barcode.SWEEP]
    for n, (_, _, attempts) in got.items():  # each page is read so many times, in order
        assert [float(a) for a in (log / n).read_text().split()] == order[:attempts]
    assert order[:6] == [0.0, 4.0, -4.0, 3.8, 3.5, 3.2] and last == -3.7 and len(order) == 29
    assert barcode.search(spark.createDataFrame([], "name string, page binary"), ["name"], FixtureRecognizer).count() == 0
