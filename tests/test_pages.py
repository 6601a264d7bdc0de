"""Golden cases of page layout, page texts and name suggestions."""

import random
import time

from pyspark.sql import functions as F

from paperloom.operators import assembly, gazetteer, layout, pages


def test_cluster():
    # the second box pulls the centre from 10 to 15, so the third, which spans 11 to 14, starts a line of its own
    boxes = [(30, 0, 10, 20), (10, 5, 10, 30), (50, 11, 10, 3), (70, 40, 10, 10)]
    assert layout.cluster(boxes) == [[(50, 11, 10, 3)], [(10, 5, 10, 30), (30, 0, 10, 20)], [(70, 40, 10, 10)]]
    # the centre moves half the way: 10, 12.5, 9.5; at 10.5, the mean of all, the last box would join
    assert layout.cluster([(0, 0, 9, 20), (10, 5, 9, 20), (20, 0, 9, 13), (30, 10, 9, 4)]) == [[(0, 0, 9, 20), (10, 5, 9, 20), (20, 0, 9, 13)], [(30, 10, 9, 4)]]


def test_joined():
    assert layout.joined([(0, 0, 10, 19), (15, 2, 10, 19)], ws=3, hs=5) == [(0, 0, 25, 20)]  # a gap of 5 under 6
    assert layout.joined([(0, 0, 10, 19), (16, 2, 10, 19)], ws=3, hs=5) == [(0, 0, 10, 19), (16, 2, 10, 19)]  # a gap of 6
    assert layout.joined([(0, 3, 30, 19), (5, 1, 10, 18)], ws=3, hs=5) == [(0, 1, 30, 19)]  # one within the other
    assert layout.joined([(0, 0, 10, 19), (8, 0, 10, 24)], ws=3, hs=5) == [(0, 0, 10, 19), (8, 0, 10, 24)]  # heights too far apart
    assert layout.joined([(0, 0, 10, 19), (11, 0, 10, 19), (22, 0, 10, 19)], ws=1, hs=9) == [(0, 0, 32, 21)]  # a joined box joins on
    assert layout.joined([], ws=1, hs=1) == []


def test_cluster_lines(spark):
    rng = random.Random(4)
    rows = [(p, i, rng.randint(0, 90), rng.randint(0, 60), rng.randint(1, 30), rng.randint(1, 20)) for p in range(20) for i in range(rng.randint(1, 25))]
    got = layout.cluster_lines(spark.createDataFrame(rows, "p long, idx int, x int, y int, w int, h int"), ["p"], 2, 6).collect()
    want = set()
    for p in range(20):
        lines = layout.cluster([r[2:] for r in rows if r[0] == p])
        want |= {(p, *b, n, k) for n, line in enumerate(lines) for k, b in enumerate(layout.joined(line, 2, 6))}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_top():
    # words on the line with the date still count; a bare year is a date
    assert pages.parse_top([["ПАСПОРТ"], ["УВД", "12"], ["ОМСКА", "05.03.2019"], ["ПОЗЖЕ", "770-012"]]) == ("УВД ОМСКА", "05.03.2019", "770-012")
    assert pages.parse_top([["ПАСПОРТ", "2019"], ["УВД"]]) == (None, "2019", None)
    assert pages.parse_top([]) == (None, None, None)


def test_bottom():
    assert pages.parse_bottom([["Иванов"], ["Пётр"], ["Ильич"], ["муж", "01.02.1980"], ["ГОР", "ОМСК"]]) == ("ИВАНОВ", "ПЁТР", "ИЛЬИЧ", "МУЖ", None, "ГОР ОМСК")
    assert pages.parse_bottom([[""], ["ФАМИЛИЯ"], ["ИВАНОВ"], ["01.02.1980", "жен"], ["г.", "омск"]]) == ("ФАМИЛИЯ", "ИВАНОВ", None, None, "01.02.1980", "ОМСК")
    assert pages.parse_bottom([]) == (None,) * 6


def test_pages_of_words(spark):
    """Lines in order whatever the order of rows; null texts are empty, and their lines count."""
    rows = [(1, 2, 1, "жен"), (1, 2, 0, "01.02.1980"), (1, 0, 0, None), (1, 1, 0, "ИВАНОВ"), (2, 0, 0, None), (None, 0, 0, "ПЕТРОВ")]
    got = {r[0]: tuple(r)[1:] for r in pages.bottom_text(spark.createDataFrame(rows, "k int, line int, idx int, text string"), ["k"]).collect()}
    assert got == {1: ("ИВАНОВ", None, None, None, "01.02.1980", None), 2: (None,) * 6, None: ("ПЕТРОВ", None, None, None, None, None)}
    assert pages.top_page(spark.createDataFrame([], "k int, line int, idx int, text string"), ["k"]).count() == 0


def test_patronymic(spark):
    kind = "id int, key string, gender int"
    names = spark.createDataFrame([(1, "ИБРАГИМ", 1), (2, "ЛЕЙЛА", 2)], kind)
    fathers = spark.createDataFrame([(1, "ИВАНОВИЧ", 1), (2, "ИЛЬИНИЧНА", 2)], kind)
    asked = spark.createDataFrame([(w,) for w in ("ИБРАГИМ ОГЛЫ", "ИБРАГАМ-КЫЗЫ", "ИБРАГИМ ОГЛЫ ХХХХХХ", "ИВАНОВИЧ", "ИВАННАВЕЧ", "ЭЭЭЭЭЭЭЭ ОГЛЫ", None)], "word string")
    got = {r.word: (r.value, r.gender, r.score) for r in gazetteer.pick_patronymic(asked, names, fathers).collect()}
    assert got == {
        "ИБРАГИМ ОГЛЫ": ("ИБРАГИМ ОГЛЫ", "MALE", 1.0), "ИБРАГАМ-КЫЗЫ": ("ИБРАГИМ КЫЗЫ", "FEMALE", 0.75), "ИБРАГИМ ОГЛЫ ХХХХХХ": ("ИБРАГИМ ОГЛЫ", "MALE", 0.75),
        "ИВАНОВИЧ": ("ИВАНОВИЧ", "MALE", 1.0), "ИВАННАВЕЧ": ("ИВАНОВИЧ", "MALE", 0.4),
    }


def test_licence_without_answers(spark):
    kind = "id int, key string, gender int"
    g = spark.createDataFrame([(1, "ИВАН", 1)], kind)
    people = spark.createDataFrame([(1, "ФФФФФФФ", "  ИВАН  ", "x"), (2, "ФФФФФФФ", "ЩЩЩЩЩЩЩЩ", "y"), (3, None, None, None)], "k int, fam_rus string, name_rus string, word string")
    got = {r.k: r.suggest for r in gazetteer.suggest_licence(people, g, g, g).collect()}
    assert (got[1].I, got[1].I_gender, got[1].I_score, got[1].F, got[1].F_score) == ("ИВАН", "MALE", 1.0, None, 0.0) and got[2] is got[3] is None


def test_suggest_by_ways(spark):
    """Both readings, one of them, or none; null parts; repeated rows and other columns stay."""
    g = spark.createDataFrame([(1, "ИВАН", 1), (2, "АННА", 2), (3, "ПЕТРОВ", 0), (4, "ОЛЕГОВИЧ", 1)], "id long, key string, gender int")
    schema = "k int, suggested string, zone struct<f:string, i:string, o:string>, bottom struct<F:string, I:string, O:string>"
    rows = [
        (1, "a", ("ПЕТРОВ", "ИВАН", "ОЛЕГОВИЧ"), ("ПЕТРОБ", "ИВАН", None)),
        (2, None, None, ("ПЕТРОВ ЛИШНЕЕ", None, "ОЛЕГОВИЧЬ")),
        (3, "c", None, None),
        (4, "d", ("", "ЩЩЩЩЩЩЩЩ", ""), (None, "ЮЮЮЮЮЮЮЮ", "")),
        (1, "a", ("ПЕТРОВ", "ИВАН", "ОЛЕГОВИЧ"), ("ПЕТРОБ", "ИВАН", None)),
    ]
    pages_ = spark.createDataFrame(rows, schema)
    ways = assembly.suggestion_ways(F.col("zone"), F.col("bottom"))
    got = gazetteer.suggest_by_ways(pages_, ways, g, g, g).orderBy("k").collect()
    assert [r.k for r in got] == [1, 1, 2, 3, 4] and got[0].suggested == "a"
    assert got[0] == got[1] and tuple(got[0].suggest) == ("ПЕТРОВ", "UNKNOWN", 1.0, "ИВАН", "MALE", 1.0, "ОЛЕГОВИЧ", "MALE", 1.0)
    assert tuple(got[2].suggest) == ("ПЕТРОВ", "UNKNOWN", 0.75, None, None, 0.0, "ОЛЕГОВИЧ", "MALE", 0.8)
    assert got[3].suggest is None and got[4].suggest is None
    assert gazetteer.suggest_by_ways(pages_.limit(0), ways, g, g, g).count() == 0


def test_licence_front_in_batches(spark):
    """Python gets batches of pages, not a call for each page; pages equal those read one by one."""
    rng = random.Random(6)
    texts = ["ПЕТРОВ", "PETROV", "ИВАН", "01.02.1980", "ОМСК", "09.10.2018", "5512345678", "a. b", "", None]
    rows = [(p, lang, i if rng.random() < 0.9 else None, rng.choice([40, 60, 314]), rng.randint(2, 36) * 10, rng.choice(texts)) for p in range(30) for lang in ("rus", "eng", None)[: p % 4] for i in range(rng.randint(1, 14))]
    df = spark.createDataFrame(rows, "p long, lang string, idx int, left int, top int, text string")
    got = pages.licence_front(df, ["p"])
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
    want = {}
    for p in {r[0] for r in rows}:
        one = sorted((r[2] is None, r[2] or 0, *r[3:5], r[5] or "", r[1]) for r in rows if r[0] == p and r[1])
        rus, eng = (pages.front_fields([r[2:5] for r in one if r[5] == lang]) for lang in ("rus", "eng"))
        want[p] = (rus.get("fam_rus"), eng.get("fam_eng"), rus.get("name_rus"), eng.get("birthplace3_eng"), rus.get("p4c_rus"), eng.get("p8_eng"))
    assert {r.p: (r.fam_rus, r.fam_eng, r.name_rus, r.birthplace3_eng, r.p4c_rus, r.p8_eng) for r in got.collect()} == want


def test_cluster_many_lines():
    """A page of very many lines, and of one very long line, equals the plain rule and takes no square of them."""
    def plain(boxes):
        lines = []
        for box in boxes:
            _, y, _, h = box
            at = next((k for k, (c, _) in enumerate(lines) if y < c < y + h), None)
            if at is None:
                lines.append((y + h / 2, [box]))
            else:
                lines[at] = ((lines[at][0] + y + h / 2) / 2, [*lines[at][1], box])
        return [sorted(members) for _, members in sorted(lines, key=lambda v: v[0])]

    rng = random.Random(8)
    for _ in range(300):
        top = rng.choice([10, 60, 2000])
        boxes = [(rng.randint(0, 90), rng.randint(0, top), 9, rng.randint(0, 25)) for _ in range(rng.randint(0, 60))]
        assert layout.cluster(boxes) == plain(boxes)
    start = time.process_time()
    assert len(layout.cluster([(0, 20 * i, 9, 13) for i in range(30_000)])) == 30_000
    assert len(layout.cluster([(i, 0, 9, 13) for i in range(30_000)])) == 1
    assert time.process_time() - start < 5


def test_cluster_lines_in_batches(spark):
    got = layout.cluster_lines(spark.createDataFrame([(1, 0, 0, 0, 9, 9), (None, None, 5, 5, 9, 9), (None, 3, 1, 1, 2, 2)], "p long, idx int, x int, y int, w int, h int"), ["p"], 0, 0)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in got.collect() if r.p) == [(1, 0, 0, 9, 9, 0, 0)]
    assert [tuple(r) for r in got.collect() if r.p is None] == [(None, 1, 1, 2, 2, 0, 0), (None, 5, 5, 9, 9, 1, 0)]
