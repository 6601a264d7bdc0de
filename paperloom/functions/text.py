"""Text clean-up and tolerant search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.dates import SEPARATOR


def normalise(text: Column) -> Column:
    """Upper-case Russian letters and the number sign; everything else goes, Ё and ё among it."""
    return F.upper(F.regexp_replace(text, "[^А-Яа-я№]", ""))


def letters_to_digits(s: Column) -> Column:
    """Letters that readers take digits for, as digits; other non-digits go."""
    return F.regexp_replace(F.translate(s, "OISB<", "01580"), "[^0-9]", "")


def digits_to_letters(s: Column) -> Column:
    return F.translate(s, "015", "OIS")


def digits_to_russian(s: Column) -> Column:
    return F.translate(s, "0358", "ОЗБВ")


def error_patterns(sub: str) -> list[str]:
    """The patterns that find `sub` with one character inserted, then with one replaced or missing."""
    s = sub.upper()
    return [s[:i] + ".?" + s[i:] for i in range(1, len(s))] + [s[:i] + ".?" + s[i + 1 :] for i in range(len(s))]


def search_with_error(source: Column, sub: str) -> Column:
    """struct(start, end), 0-based, of the first pattern that matches anywhere, at its leftmost match; null if none does."""
    up = F.upper(source)
    spans = []
    for p in error_patterns(sub):
        got = F.regexp_extract(up, f"({p})", 1)
        start = F.regexp_instr(up, F.lit(f"({p})")) - 1
        spans.append(F.when(up.rlike(p), F.struct(start.alias("start"), (start + F.length(got)).alias("end"))))
    return F.coalesce(*spans)


def found(source: Column, sub: str) -> Column:
    return F.coalesce(F.upper(source).rlike("|".join(error_patterns(sub))), F.lit(False))


# Separators of surname and given names in the first line of a zone, in order of preference.
NAME_SEPARATORS = ("<<", "K<", "<K", "X<", "<X", "<")


def name_separator(line: Column) -> Column:
    """struct(start, end) of the first separator, by preference, that the line has."""
    up = F.upper(line)
    return F.coalesce(*[F.when(F.instr(up, s) > 0, F.struct((F.instr(up, s) - 1).alias("start"), (F.instr(up, s) - 1 + len(s)).alias("end"))) for s in NAME_SEPARATORS])


def strip_separators(s: Column, by: str = "") -> Column:
    return F.regexp_replace(s, SEPARATOR, by)


def department_code(line: Column) -> Column:
    """NNN-NNN with its separator, not next to other digits; null if absent."""
    got = F.regexp_extract(line, f"(?:[^0-9]|^)([0-9]{{3}}{SEPARATOR}[0-9]{{3}})(?:[^0-9]|$)", 1)
    return F.when(got != "", got)


def gender_token(line: Column) -> Column:
    """МУЖ or ЖЕН if a token of two or three Russian capitals is like one of them; null otherwise."""
    got = F.regexp_extract(F.upper(line), "(?:[^А-Я]|^)([А-Я]{2,3})(?:[^А-Я]|$)", 1)
    return F.when(got == "", F.lit(None).cast("string")).when(found(got, "МУЖ"), "МУЖ").when(found(got, "ЖЕН"), "ЖЕН")


def line_gender(line: Column) -> Column:
    """МУЖ or ЖЕН by tolerant search in a whole line, common misreadings included."""
    male = found(line, "МУЖ") | found(line, "МУХ") | found(line, "МИЖ")
    return F.when(male, "МУЖ").when(found(line, "ЖЕН") | found(line, "ХЕН"), "ЖЕН")


def serial_tail(line: Column) -> Column:
    """The last ten digits; with letters read as digits if there are fewer; null if still fewer."""
    d, e = F.regexp_replace(line, "[^0-9]", ""), letters_to_digits(line)
    return F.when(F.length(d) >= 10, F.right(d, F.lit(10))).when(F.length(e) >= 10, F.right(e, F.lit(10)))


def pick_serial(a: Column, b: Column) -> Column:
    """Of two readings without separators, one with length ten (the first before the second), else the first that isn't empty."""
    x, y = strip_separators(a), strip_separators(b)
    has = lambda c: c.isNotNull() & (c != "")
    return F.when(has(x) & has(y), F.when(F.length(x) == 10, x).when(F.length(y) == 10, y).otherwise(x)).when(has(x), x).when(has(y), y)


# Second words of Turkic patronymics.
TURKIC = "ОГЛЫ|ОГЛУ|УЛЫ|УУЛУ|КЫЗЫ|ГЫЗЫ"


def turkic_split(s: Column) -> Column:
    """struct(name, suffix) of a Turkic patronymic, or null."""
    p = f"^([А-Я]*){SEPARATOR}({TURKIC})$"
    return F.when(s.rlike(p), F.struct(F.regexp_extract(s, p, 1).alias("name"), F.regexp_extract(s, p, 2).alias("suffix")))


# Licence categories after reading 8 as B; alternatives in order of preference.
CATEGORY = "([CD]1E)|([ABCD]1)|([BCD]E)|([ABCDM])"


def licence_categories(line: Column) -> Column:
    """Sorted distinct categories that a line names."""
    up = F.translate(F.upper(line), "8", "B")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(up, F.lit(f"({CATEGORY})"), F.lit(1))))


def supported_file(path: Column) -> Column:
    """True for paths that end in an extension that is accepted."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin("pdf", "png", "jpeg", "jpg", "jpe")
