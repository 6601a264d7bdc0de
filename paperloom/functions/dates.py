"""Dates kept as the strings that recognizers give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# An optional separator between the parts of a date, a full date, and a bare year.
SEPARATOR = r"(?: [.—-]|[.—-] |[.— -])"
FULL_DATE = rf"([0-3][0-9]{SEPARATOR}?[0-1][0-9]{SEPARATOR}?(?:19|20)[0-9]{{2}})"
BARE_YEAR = r"(?:[^АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ]|^)((?:19|20)[0-9]{2})(?:[^0-9]|$)"


def find_date(line: Column) -> Column:
    """DD.MM.YYYY if the line has a full date, else YYYY if it has a bare year, else null."""
    full, year = F.regexp_extract(line, FULL_DATE, 1), F.regexp_extract(line, BARE_YEAR, 1)
    # separators become dots, and dots that are missing are put in
    d = F.regexp_replace(F.regexp_replace(full, SEPARATOR, "."), r"^(..)\.?(..)\.?(....)$", "$1.$2.$3")
    return F.when(full != "", d).when(year != "", year)


def compare_dates(a: Column, b: Column) -> Column:
    """The later of two lines' dates as strings; the only one if the other line is null; null if a line is empty."""
    da, db = find_date(a), find_date(b)
    both = F.when(da.isNotNull() & db.isNotNull(), F.greatest(da, db)).when(da.isNotNull(), da).otherwise(db)
    return F.when((a == "") | (b == ""), F.lit(None).cast("string")).when(a.isNull(), db).when(b.isNull(), da).otherwise(both)


def check_dates(a: Column, b: Column) -> Column:
    """True if b is ten years after a: same length without dots, same day and month or years alone, last two digits ten apart."""
    x, y = F.regexp_replace(a, r"\.", ""), F.regexp_replace(b, r"\.", "")
    two = lambda s: F.try_to_number(F.right(s, F.lit(2)), F.lit("99")).cast("int")
    same = (F.length(x) == 4) | (F.left(x, F.lit(4)) == F.left(y, F.lit(4)))
    fine = x.rlike("[0-9]{2}$") & y.rlike("[0-9]{2}$") & (F.length(x) == F.length(y)) & same
    return F.coalesce(F.when(fine, two(x) + 10 == two(y)).otherwise(F.lit(False)), F.lit(False))


def mrz_date(yymmdd: Column, as_of_year: int) -> Column:
    """DD.MM.YYYY of YYMMDD; two-digit years below that of as_of_year are of this century."""
    yy = F.left(yymmdd, F.lit(2))
    century = F.when(yy.cast("int") < as_of_year - 2000, "20").otherwise("19")
    return F.when(yymmdd.rlike("^[0-9]{6}$"), F.concat(F.right(yymmdd, F.lit(2)), F.lit("."), F.substr(yymmdd, F.lit(3), F.lit(2)), F.lit("."), century, yy))
