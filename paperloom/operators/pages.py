"""Fields of whole document pages from recognized words: serial numbers, passport pages, licence fronts, handwriting strips."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions.dates import BARE_YEAR, FULL_DATE, SEPARATOR, check_dates, compare_dates
from paperloom.functions.text import error_patterns, pick_serial
from paperloom.functions.translit import translit_check


def serial_of_halves(left: Column, left_raw: Column, right: Column, right_raw: Column) -> Column:
    """struct(value, checked) of a line whose two halves were read apart, with the counts of raw digits; null if neither has ten digits."""
    ten = lambda c: F.coalesce(F.length(c) == 10, F.lit(False))
    both = ten(left) & ten(right) & (left == right)
    value = F.when(both, left).when(ten(left) & (left_raw >= right_raw), left).when(ten(right) & (right_raw >= left_raw), right)
    return F.when(value.isNotNull(), F.struct(value.alias("value"), F.coalesce(both, F.lit(False)).alias("checked")))


def serial_number(halves: DataFrame, page: list[str]) -> DataFrame:
    """halves (page, line, left, left_raw, right, right_raw): the first of a page's first two lines that gives a value."""
    s = halves.where("line < 2").withColumn("s", serial_of_halves(F.col("left"), F.col("left_raw"), F.col("right"), F.col("right_raw")))
    best = s.groupBy(*page).agg(F.min_by("s", F.when(F.col("s").isNotNull(), F.col("line"))).alias("s"))
    return best.select(*page, F.col("s.value").alias("serial_number"), F.coalesce("s.checked", F.lit(False)).alias("serial_number_check"))


def upper_share(token: str) -> bool:
    t = token.upper()
    n = len(t.replace(" ", ""))
    return n > 0 and sum(c.isupper() for c in t) > 0.7 * n


CODE = re.compile(rf"(?:[^0-9]|^)([0-9]{{3}}{SEPARATOR}[0-9]{{3}})(?:[^0-9]|$)")


def date_in(line: str) -> str | None:
    """As `find_date` for a column: the full date of a line, else its bare year."""
    if m := re.search(FULL_DATE, line):
        return re.sub(r"^(..)\.?(..)\.?(....)$", r"\1.\2.\3", re.sub(SEPARATOR, ".", m[1]))
    return m[1] if (m := re.search(BARE_YEAR, line)) else None


def gender_in(line: str) -> str | None:
    """As `gender_token` for a column: МУЖ or ЖЕН if the first token of two or three capitals is like one of them."""
    m = re.search("(?:[^А-Я]|^)([А-ЯЁ]{2,3})(?:[^А-Я]|$)", line)
    return next((g for g in ("МУЖ", "ЖЕН") if m and any(re.search(p, m[1]) for p in error_patterns(g))), None)


def parse_top(lines: list[list[str]]) -> tuple[str | None, str | None, str | None]:
    """(vidan, data_vid, code_pod): from the second line up to the line with a date or a code, that line included, tokens in
    capitals make up the issuing office."""
    office, date, code = [], None, None
    for n, tokens in enumerate(lines):
        line = " ".join(tokens).upper()
        if n and date is None and code is None:
            office += [t.upper() for t in tokens if upper_share(t)]
        date = date or date_in(line)
        if code is None and (m := CODE.search(line)):
            code = m[1]
    return " ".join(office) or None, date, code


# Labels of the lower page, which are no names; the first two within a text, the others as the whole run.
LABELS, LABEL_WORDS = ("ФАМИЛИЯ", "ОТЧЕСТВО"), ("ИМЯ", "ПОЛ", "МУЖ", "ЖЕН")


def parse_bottom(lines: list[list[str]]) -> tuple[str | None, ...]:
    """(F, I, O, gender, birth_date, birth_place) of a lower page from the texts of its boxes, line by line.

    Until a birth date or gender is seen, the surname is the first of four lines that has text, and given name and patronymic
    are the next runs of Russian capitals, in lines 1 to 6 and 2 to 7; from there on words in capitals make up the birth place.
    """
    surname = given = patronymic = gender = date = None
    place: list[str] = []
    for n, boxes in enumerate(lines):
        line = ""
        for t in filter(None, (b.upper().strip() for b in boxes)):
            line += t + " "
            if len(t) < 3:
                continue
            if not (date or gender):
                date, gender = date_in(line), gender_in(line)
            run = re.search("[А-ЯЁ]{3,}", t)
            if date or gender:
                place += [w for w in t.split() if (upper_share(w) or w == "ГОР") and gender_in(w) is None]
            elif run and surname and run[0] not in LABEL_WORDS and not any(label in t for label in LABELS):
                if not given and 0 < n < 7:
                    given = run[0]
                elif not patronymic and 1 < n < 8:
                    patronymic = run[0]
        if line and not (date or gender):
            if not surname and n < 4:
                surname = line.strip()
            date, gender = date_in(line), gender_in(line)
    return surname, given, patronymic, gender, date, " ".join(place) or None


def parsed_pages(words: DataFrame, page: list[str], parse: Callable[[list[list[str]]], tuple], names: list[str]) -> DataFrame:
    """words (page, line, idx, text) as one row for each page: parse(texts by line) gives the columns `names`. Words are put
    together by Spark, so Python gets batches of pages. A null text is an empty one, and its line counts."""
    parts = F.array_sort(F.collect_list(F.struct("line", "idx", F.coalesce("text", F.lit("")).alias("text"))))

    @F.pandas_udf(", ".join(f"{n} string" for n in names))
    def run(lines: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [parse([[t for _, t in g] for _, g in groupby(zip(n, t), key=itemgetter(0))]) for n, t in zip(lines, texts)]
        return pd.DataFrame(rows, columns=names, dtype=object)

    pages = words.groupBy(*page).agg(parts.alias("__words"))
    return pages.select(*page, run("__words.line", "__words.text").alias("__got")).select(*page, "__got.*")


def top_page(words: DataFrame, page: list[str]) -> DataFrame:
    """words (page, line, idx, text) of upper passport pages: vidan, data_vid, code_pod."""
    return parsed_pages(words, page, parse_top, ["vidan", "data_vid", "code_pod"])


def bottom_text(boxes: DataFrame, page: list[str]) -> DataFrame:
    """boxes (page, line, idx, text) of lower passport pages: F, I, O, gender, birth_date, birth_place."""
    return parsed_pages(boxes, page, parse_bottom, ["F", "I", "O", "gender", "birth_date", "birth_place"])


# Fields of a licence's front in order, each with the field that it stands below, by how many rows, its x
# offset, and its x window; those whose place, once found, moves the later ones.
FRONT = (
    ("fam_rus", None, 0, 0, (-20, 300)), ("fam_eng", "fam_rus", 25, 0, (-20, 300)), ("name_rus", "fam_rus", 58, 0, (-20, 300)), ("name_eng", "name_rus", 26, 0, (-20, 300)),
    ("p3", "name_rus", 57, 0, (-20, 100)), ("birthplace3_rus", "p3", 29, 0, (-20, 300)), ("birthplace3_eng", "p3", 59, 0, (-20, 300)),
    ("p4a", "birthplace3_rus", 65, 0, (-20, 20)), ("p4b", "birthplace3_rus", 65, 254, (-40, 40)), ("p4c_rus", "p4a", 33, 0, (-20, 300)), ("p4c_eng", "p4a", 58, 0, (-20, 300)),
    ("p5", "p4c_rus", 63, 0, (-20, 100)), ("p8_rus", "p5", 30, 0, (-20, 300)), ("p8_eng", "p5", 56, 0, (-20, 300)),
)
ANCHORS = ("p3", "birthplace3_rus", "p4a", "p4b", "p4c_rus", "p5")
FRONT_X, FRONT_Y, DATE_BELOW, NEAR = 55, 25, 115, 17


def front_fields(words: list[tuple[int, int, str]]) -> dict[str, str]:
    """Fields of a licence's front from words (left, top, text) in reading order: each word goes to the first field whose
    expected place it is near; a found anchor moves what stands below it."""
    x0, y0 = FRONT_X, FRONT_Y
    for left, top, text in words:
        if re.search(FULL_DATE, re.sub(r"[^0-9.]", "", text)):
            x0, y0 = left, top - DATE_BELOW
            break
    place: dict[str, int] = {}

    def expect() -> None:
        for name, below, dy, _, _ in FRONT:
            place[name] = seen.get(name, (place[below] if below else y0) + dy)

    seen: dict[str, int] = {}
    expect()
    out: dict[str, list[str]] = {}
    for left, top, text in words:
        for name, _, _, dx, (lo, hi) in FRONT:
            if abs(top - place[name]) < NEAR and lo < left - x0 - dx < hi:
                out.setdefault(name, []).append(re.sub(SEPARATOR, " ", text) if name not in ("p3", "p4a", "p4b", "p5") else text)
                if name in ANCHORS and name not in seen:
                    seen[name] = top
                    expect()
                break
    return {k: " ".join(v).strip() for k, v in out.items()}


def licence_front(words: DataFrame, page: list[str]) -> DataFrame:
    """words (page, lang rus or eng, idx, left, top, text) of licence fronts as fields with their checks. Words are put together
    by Spark, so Python gets batches of pages. A null text is an empty one, and a null idx comes last."""
    names, langs = [f[0] for f in FRONT], ("rus", "eng")
    parts = F.array_sort(F.collect_list(F.struct(F.col("idx").isNull().alias("none"), "idx", "left", "top", F.coalesce("text", F.lit("")).alias("text"), "lang")))

    @F.pandas_udf(", ".join(f"{n}__{lang} string" for n in names for lang in langs))
    def run(lefts: pd.Series, tops: pd.Series, texts: pd.Series, lang_of: pd.Series) -> pd.DataFrame:
        rows = []
        for one in zip(lefts, tops, texts, lang_of):
            by: dict[str | None, list[tuple[int, int, str]]] = {}
            for *word, lang in zip(*(v.tolist() for v in one)):
                by.setdefault(lang, []).append(tuple(word))
            got = [front_fields(by.get(lang, [])) for lang in langs]
            rows.append([g.get(n) for n in names for g in got])
        return pd.DataFrame(rows, columns=[f"{n}__{lang}" for n in names for lang in langs], dtype=object)

    pages = words.groupBy(*page).agg(parts.alias("__words"))
    raw = pages.select(*page, run(*(f"__words.{k}" for k in ("left", "top", "text", "lang"))).alias("__got")).select(*page, "__got.*")
    c = lambda n, lang: F.col(f"{n}__{lang}")
    date = {n: compare_dates(c(n, "rus"), c(n, "eng")) for n in ("p3", "p4a", "p4b")}
    pair = {n: (c(f"{n}_rus", "rus"), c(f"{n}_eng", "eng")) for n in ("fam", "name", "birthplace3", "p4c", "p8")}
    fields = [e.alias(f"{n}_{k}") for n, v in pair.items() for e, k in zip(v, ("rus", "eng"))]
    checks = [translit_check(*v, place=n == "birthplace3").alias(f"{n}_check") for n, v in pair.items()]
    p5 = F.regexp_replace(pick_serial(c("p5", "rus"), c("p5", "eng")), "[^0-9]", "")
    staged = raw.select(*page, *fields, *checks, *[v.alias(k) for k, v in date.items()], p5.alias("p5"))
    return staged.withColumn("p4ab_check", check_dates(F.col("p4a"), F.col("p4b")))


def strip_cuts(w: Column, h: Column) -> Column:
    """The x ranges of the pieces that a field's strip is cut into, each four heights wide; the whole strip if it is shorter."""
    n = F.greatest(F.floor(F.bround(w / h) / 4), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * 4 * h).alias("x"), F.least((i + 1) * 4 * h, w).alias("end")))


def vote_categories(text: Column) -> Column:
    """Sorted categories of a licence read several times over: of each family with a suffix the first, if it was seen more than
    twice, and the most frequent plain letter."""
    up = F.translate(F.upper(text), "8", "B")
    found = F.regexp_extract_all(up, F.lit("([CD]1E|[ABCD]1|[BCD]E|[ABCDM])"), F.lit(1))
    family = lambda p: F.filter(found, lambda t: t.rlike(p))
    count = lambda xs, t: F.size(F.filter(xs, lambda y: y == t))
    picked = []
    for p in ("^[CD]1E$", "^[ABCD]1$", "^[BCD]E$"):
        first = F.get(family(p), F.lit(0))
        picked.append(F.when(count(family(p), first) > 2, first))
    plain = F.array(*[F.struct(count(family("^[ABCDM]$"), F.lit(x)).alias("n"), F.lit(-i).alias("o"), F.lit(x).alias("c")) for i, x in enumerate("ABCDM")])
    best = F.array_max(plain)
    picked.append(F.when(best["n"] > 0, best["c"]))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*picked))))


def line_degrees(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The angle of a line in degrees, within -90 and 90."""
    a = F.degrees(F.atan2(y2 - y1, x2 - x1))
    return F.when(a > 90, a - 180).when(a < -90, a + 180).otherwise(a)


def merge_progress(updates: DataFrame, job: str, page: str, order: str) -> DataFrame:
    """updates (job, page, order, document_type, page_progress, qc) as one entry for each page, as they come in order.

    The first update makes the entry, with its type if that is known (0 is not) and qc -1; later ones change its progress
    alone. An update with qc is the page's result and takes the entry's place, whose progress is then that of updates after it.
    """
    u = updates.withColumn("_done", F.max(F.when(F.col("qc").isNotNull(), F.col(order))).over(W.partitionBy(job, page)))
    result, going = F.col("qc").isNotNull(), F.col("qc").isNull()
    after = going & (F.col("_done").isNull() | (F.col(order) > F.col("_done")))
    got = u.groupBy(job, page).agg(
        F.max(F.when(result, F.struct(order, "document_type", "qc"))).alias("r"), F.min(F.when(going, F.struct(order, "document_type"))).alias("f"), F.max(F.when(after, F.struct(order, "page_progress"))).alias("l"),
    )
    kind = F.when(F.col("r").isNotNull(), F.col("r.document_type")).when(F.col("f.document_type") != 0, F.col("f.document_type"))
    return got.select(job, page, kind.alias("document_type"), F.col("l.page_progress").alias("page_progress"), F.when(F.col("r").isNotNull(), F.col("r.qc")).otherwise(-1).alias("qc"))
