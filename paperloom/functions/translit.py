"""Transliteration of Russian names under two rule sets, as they are printed on licences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rules in force before and since 2015.
VOWELS_AND_SIGNS = "ЬЪАЕЁИЙОЫЭЮЯ"
#: letter, what it becomes, at the start too, after which letters; in order
OLD_CONTEXT = (("Е", "YE", True, VOWELS_AND_SIGNS), ("Ё", "E", False, "ЧШЩЖ"), ("Ё", "YO", True, VOWELS_AND_SIGNS), ("Ё", "YE", False, "БВГДЗКЛМНПРСТФХЦ"), ("И", "YI", False, "Ь"))
OLD_LETTERS = ("АБВГДЕЗИЙКЛМНОПРСТУФЪЫЬЭ", "ABVGDEZIYKLMNOPRSTUF'Y'e")
NEW_LETTERS = ("АБВГДЕЗИЙКЛМНОПРСТУФЫЬЭ", "ABVGDEZIIKLMNOPRSTUFY'e")
OLD_MULTI = {"Ж": "ZH", "Х": "KH", "Ц": "TS", "Ч": "CH", "Ш": "SH", "Щ": "SHCH", "Ю": "YU", "Я": "YA"}
NEW_MULTI = {"Ж": "ZH", "Х": "KH", "Ц": "TS", "Ч": "CH", "Ш": "SH", "Щ": "SHCH", "Ю": "IU", "Я": "IA", "Ъ": "IE"}
MRZ_LATIN = "ABVGDE2JZIQKLMNOPRSTUFHC34WXY9678"
MRZ_RUSSIAN = "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"


def _in_context(s: Column, letter: str, to: str, at_start: bool, after: str) -> Column:
    """Replace a letter where what has been put out so far ends in one of `after` (or is empty, if at_start)."""

    def step(out: Column, c: Column) -> Column:
        here = (F.length(out) > 0) & F.contains(F.lit(after), F.right(out, F.lit(1)))
        if at_start:
            here = here | (F.length(out) == 0)
        return F.concat(out, F.when((c == letter) & here, F.lit(to)).otherwise(c))

    # s stands here once: chained rules would otherwise multiply it
    return F.aggregate(F.split(s, ""), F.lit(""), step)


def _finish(s: Column, letters: tuple[str, str], multi: dict[str, str]) -> Column:
    s = F.translate(s, *letters)
    for a, b in multi.items():
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def translit_old(s: Column) -> Column:
    for rule in OLD_CONTEXT:
        s = _in_context(s, *rule)
    return _finish(s, OLD_LETTERS, OLD_MULTI)


def translit_new(s: Column) -> Column:
    return _finish(s, NEW_LETTERS, NEW_MULTI)


def translit_check(rus: Column, lat: Column, place: bool = False) -> Column:
    """True if lat is a transliteration of rus; II may have been read as I, and in places RESP and OBL may be short for longer words."""
    old, new = translit_old(rus), translit_new(rus)
    one = lambda c: F.replace(c, F.lit("II"), F.lit("I"))
    ways = [old, new, one(new)]
    if place:
        for base, resp in ((old, "RESPUBLICA"), (new, "RESPUBLIKA")):
            full = F.regexp_replace(base, r"RESP\.?", resp)
            both = [F.regexp_replace(full, r"OBL\.?", w) for w in ("OBLAST'", "OBLAST")]
            ways += both if base is old else both + [one(b) for b in both]
    return F.coalesce((F.length(rus) > 1) & (F.length(lat) > 1) & F.array_contains(F.array(*ways), lat), F.lit(False))


def mrz_russian(s: Column) -> Column:
    """Latin letters of a machine-readable zone as the Russian ones they stand for; others become underscores."""
    return F.translate(F.regexp_replace(s, f"[^{MRZ_LATIN}]", "_"), MRZ_LATIN, MRZ_RUSSIAN)
