"""Golden cases and plain models of the scalar functions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from paperloom.functions import checks, dates, text, translit
from paperloom.operators import barcode, jobs, mrz, rules


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


@pytest.mark.parametrize("line,want", [("13.32.2017", "2017"), ("1312.2017", "13.12.2017"), ("1312 .2017", "13.12.2017"), ("4.6.2077", "2077"), ("42320774", None), (None, None), ("", None)])
def test_find_date(spark, line, want):
    assert one(spark, d=dates.find_date(F.lit(line).cast("string"))).d == want


@pytest.mark.parametrize("a,b,want", [("09.10.2018", "09.10.2028", True), ("09.1s.2018", "09.10.2028", False), ("2010", "2020", True), (None, "2020", False), ("2010", None, False), ("09.10.1995", "09.10.2005", False)])
def test_check_dates(spark, a, b, want):
    assert one(spark, ok=dates.check_dates(F.lit(a).cast("string"), F.lit(b).cast("string"))).ok is want


def test_compare_dates(spark):
    d = dates.compare_dates
    s = lambda x: F.lit(x).cast("string")
    assert tuple(one(spark, a=d(s(""), s("2010")), b=d(s(None), s("2010")), c=d(s("2011"), s("2010")), e=d(s(None), s(None)))) == (None, "2010", "2011", None)


def test_search_with_error(spark):
    got = one(spark, s=text.search_with_error(F.lit(".PcRUS"), "PNRUS")).s
    assert (got.start, got.end) == (1, 6)


def plain_search(source, sub):
    for p in text.error_patterns(sub):
        if m := re.search(p, source.upper()):
            return m.span()
    return None


def test_search_like_plain(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("PNRUSx<") for _ in range(rng.randint(0, 12))),) for _ in range(400)]
    df = spark.createDataFrame(rows, "t string").select("t", text.search_with_error(F.col("t"), "PNRUS").alias("s"))
    for r in df.collect():
        assert (tuple(r.s) if r.s else None) == plain_search(r.t, "PNRUS")


def test_translit(spark):
    L = F.lit
    got = one(
        spark, a=translit.translit_old(L("РЕСП. ДАГЕСТАН")), b=translit.translit_old(L("ЕАЛЬИСЬEEЬEЯ")),
        c=translit.translit_check(L("ЛИВИЯ"), L("LIVIIA")), d=translit.translit_check(L("ЛИВИЯ"), L("LIVIA")), e=translit.translit_check(L("ЛИВИЯ"), L("LIVIYA")),
        f=translit.translit_check(L("ИРКУТСКАЯ ОБЛ"), L("IRKUTSKAIA OBLAST'"), True), g=translit.translit_check(L("РЕСП ДАГЕСТАН"), L("RESPUBLIKA DAGESTAN"), True),
        h=translit.translit_check(L("УКРАИНА"), L("UKRAINA"), True), i=translit.translit_check(L("Я"), L("IA")),
    )
    assert tuple(got) == ("RESP. DAGESTAN", "YEAL'YIS'EE'EYA", True, True, True, True, True, True, False)


def test_barcodes(spark):
    rows = [("019912919146",), ("19956929615",), ("199120919221",), ("199765939714",), ("1991012979226",), ("19956929616",), ("",), ("abc",), (None,), ("1",)]
    df = spark.createDataFrame(rows, "data string")
    got = [(r.payload.document_type, r.payload.page) if r.payload else None for r in barcode.parse(df).collect()]
    assert sorted(filter(None, got)) == [(10, 1), (46, 2), (80, 1), (501, 3), (522, 7)] and got.count(None) == 5


def test_mrz(spark):
    line = "1235678909RUS8502142M<<<<<<<4190305770012<76"
    m = one(spark, m=mrz.second_line(F.lit(line))).m
    assert (m.s_number, m.s_number_check, m.birth_date, m.birth_date_check, m.gender, m.issue_date, m.code, m.final_check) == ("1234567890", True, "850214", True, "M", "190305", "770012", True)
    for at in (2, 14, 30):
        bad = line[:at] + str((int(line[at]) + 1) % 10) + line[at + 1 :]
        m = one(spark, m=mrz.second_line(F.lit(bad))).m
        assert (at == 2) != m.s_number_check and (at == 14) != m.birth_date_check and (at == 30) != m.issue_date_and_code_check and not m.final_check


def test_check_digit_round_trip(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choice("0123456789") for _ in range(rng.randint(1, 39))),) for _ in range(200)]
    df = spark.createDataFrame(rows, "b string").withColumn("d", checks.mrz_digit(F.col("b")))
    assert df.where(~checks.mrz_check(F.concat("b", "d"))).count() == 0


def test_check_sums(spark):
    """Packed sums equal plain ones for every number of digits, with the greatest digits too."""
    rng = random.Random(4)
    rows = [(d,) for n in range(1, 41) for d in ("9" * n, "".join(rng.choice("0123456789") for _ in range(n)))]
    plain = lambda d, w: sum(int(c) * w[i % len(w)] for i, c in enumerate(d))
    df = spark.createDataFrame(rows, "d string")
    for n in (1, 6, 9, 14, 15, 16, 30, 39):
        got = df.where(F.length("d") == n).select("d", checks._packed(F.col("d"), (7, 3, 1), n).alias("n")).collect()
        assert got and all(r.n == plain(r.d, (7, 3, 1)) for r in got)
    got = df.select("d", checks.mrz_check(F.col("d"), 40).alias("ok")).collect()
    assert all(r.ok == (len(r.d) == 40 and plain(r.d[:-1], (7, 3, 1)) % 10 == int(r.d[-1])) for r in got)
    odd = one(spark, a=checks.mrz_check(F.lit(None).cast("string"), 7), b=checks.mrz_check(F.lit("12A4567"), 7), c=checks.mrz_check(F.lit(""), 7), d=checks.i25_body(F.lit("12x")), e=checks.i25_body(F.lit("")))
    assert (odd.a, odd.b, odd.c, odd.d, odd.e) == (False, False, False, None, None)


def test_rules(spark):
    assert [r[3] for r in rules.by_priority()][:1] == [520] and [r[3] for r in rules.by_priority()][-4:] == [10, 60, 110, 110]
    t = one(spark, a=rules.classify(F.lit("ДОГОВОРКУПЛИПРОДАЖИ")), b=rules.classify(F.lit("ДОГОВОРКУПЛИПРОДАЖИПРИЛОЖЕНИЕ")), c=rules.classify(F.lit("ПАСПОРТТРАНГОСРЕДСТОСОБЫЕОТМЕТКИ")), d=rules.classify(F.lit("ПАСПОРТТРАНГОСРЕДСТОСОБЫЕОТМЕТКИ"), strict=False))
    assert [x and x.document_type for x in t] == [11, 60, 60, 110]


def plain_marks(rows):
    """Pages (type, qc) in order by a loop."""
    out, last, n = [], None, 0
    for kind, qc in rows:
        if kind in (100, 130, 140) and qc in (3, 4):
            n += 1
            most = rules.CONTINUED.get(last)
            out.append((last, 0) if most is not None and (most == 0 or n < most) else (kind, qc))
        else:
            out.append((kind, qc))
            if kind is not None:
                last, n = kind, 0
    return out


def test_continuation(spark):
    rng = random.Random(3)
    books = {j: [(rng.choice([40, 11, 56, 80, 10, 100, 130, 140, 140, 140, None]), rng.choice([0, 3, 4])) for _ in range(rng.randint(1, 12))] for j in range(150)}
    books[999] = [(40, 4), (140, 3), (140, 3)]
    rows = [(j, p, k, q, "d") for j, b in books.items() for p, (k, q) in enumerate(b)]
    df = spark.createDataFrame(rows, "job_id long, page_num int, document_type int, qc int, description string")
    got = {}
    for r in jobs.mark_continuation(df).orderBy("job_id", "page_num").collect():
        got.setdefault(r.job_id, []).append((r.document_type, r.qc))
    assert got == {j: plain_marks(b) for j, b in books.items()}
    assert [k for k, _ in got[999]] == [40, 40, 140]
