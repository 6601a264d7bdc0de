"""Fused fields with trust levels, and quality codes.

A field comes from the first source that applies, even if that source's value is null: a chain of conditions, which
coalescing values would not be.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.dates import mrz_date

SURE, MAYBE, UNSURE = "True", "Possible", "False"


def truthy(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def chain(*sources: tuple[Column, Column, Column | str], short: Column | None = None) -> Column:
    """struct(value, value_short, trusted) of the first (applies, value, trust); null if no source applies or its value is null.
    short: tells for a value whether it is a short one."""
    none = F.lit(None).cast("string")
    value = trust = None
    for applies, v, t in sources:
        value = F.when(yes(applies), v) if value is None else value.when(yes(applies), v)
        t = F.lit(t) if isinstance(t, str) else t
        trust = F.when(yes(applies), t) if trust is None else trust.when(yes(applies), t)
    is_short = F.lit(False) if short is None else short
    whole = F.when(~is_short, value).otherwise(none)
    part = F.when(is_short, value).otherwise(none)
    return F.when(value.isNotNull(), F.struct(whole.alias("value"), part.alias("value_short"), trust.alias("trusted")))


def passport(p: dict[str, Column], as_of_year: int) -> dict[str, Column]:
    """Fused fields of a passport page. p: qc, serial_number, serial_number_check, and the structs MRZ, main_top_page,
    main_bottom_page, suggest (null if the part is absent). All null if qc is above 2."""
    m, top, bottom, s = p["MRZ"], p["main_top_page"], p["main_bottom_page"], p["suggest"]
    sn, sn_ok, any_sn = p["serial_number"], yes(p["serial_number_check"]), p["serial_number"].isNotNull()
    m_sn = m["s_number_check"]
    out = {
        "serial_number1": chain((sn_ok, F.left(sn, F.lit(4)), SURE), (m_sn, F.left(m["s_number"], F.lit(3)), SURE), (any_sn, F.left(sn, F.lit(4)), UNSURE), short=~sn_ok & yes(m_sn)),
        "serial_number2": chain((sn_ok, F.substr(sn, F.lit(5)), SURE), (m_sn, F.substr(m["s_number"], F.lit(4)), SURE), (any_sn, F.substr(sn, F.lit(5)), UNSURE)),
    }
    for name in "FIO":
        low = name.lower()
        out[name] = chain((m[f"mrz_{low}_check"], m[f"mrz_{low}"], SURE), (s[name].isNotNull() & (s[f"{name}_score"] >= 0.75), s[name], MAYBE), (bottom.isNotNull(), bottom[name], UNSURE), (m.isNotNull(), m[f"mrz_{low}"], UNSURE))
    from_mrz = lambda f: mrz_date(m[f], as_of_year)
    birth = chain((m["birth_date_check"], from_mrz("birth_date"), SURE), (bottom["birth_date"].isNotNull(), bottom["birth_date"], UNSURE), (m.isNotNull(), from_mrz("birth_date"), UNSURE))
    is_year = F.length(birth["value"]) == 4
    out["birth_date"] = F.when(birth.isNotNull(), F.struct(F.when(~is_year, birth["value"]).alias("value"), F.when(is_year, birth["value"]).alias("value_short"), birth["trusted"].alias("trusted")))
    printed = F.when(bottom["gender"] == "МУЖ", "M").when(bottom["gender"] == "ЖЕН", "F")
    out["gender"] = chain((m["gender_check"], m["gender"], SURE), (bottom.isNotNull(), printed, UNSURE))
    both = m["issue_date_and_code_check"]
    out["issue_date"] = chain((both, from_mrz("issue_date"), SURE), (top.isNotNull(), top["data_vid"], UNSURE), (m.isNotNull(), from_mrz("issue_date"), UNSURE))
    out["code_pod"] = chain((both, m["code"], SURE), (top.isNotNull(), top["code_pod"], F.when(yes(top["code_pod_check"]), SURE).otherwise(UNSURE)), (m.isNotNull(), m["code"], UNSURE))
    none = F.lit(None).cast("string")
    out["vidan"] = chain((truthy(top["vidan"]), top["vidan"], none))
    out["birth_place"] = chain((truthy(bottom["birth_place"]), bottom["birth_place"], none))
    return {k: F.when(p["qc"] <= 2, v) for k, v in out.items()}


def licence(p: dict[str, Column]) -> dict[str, Column]:
    """Fused fields of a driving licence: those of the front, or the serial number of the back."""
    s, front, none = p["suggest"], p["side"] == "front", F.lit(None).cast("string")
    out = {}
    for name, rus, ok in (("F", p["fam_rus"], p["fam_check"]), ("I", p["name_rus"], p["name_check"])):
        has, score = front & truthy(rus), s[f"{name}_score"]
        out[name] = chain((has & yes(ok) & (score == 1), rus, SURE), (has & (score >= 0.75), s[name], MAYBE), (has, rus, UNSURE))
    trust = lambda c: F.when(yes(c), SURE).otherwise(UNSURE)
    for name, col, t in (("birth_date", "p3", none), ("birth_place", "birthplace3_rus", trust(p["birthplace3_check"])), ("issue_date", "p4a", trust(p["p4ab_check"])), ("expiration_date", "p4b", trust(p["p4ab_check"])), ("p4c", "p4c_rus", trust(p["p4c_check"])), ("p8_place", "p8_rus", trust(p["p8_check"]))):
        year = F.length(p[col]) == 4 if name.endswith("date") else None
        out[name] = chain((front & truthy(p[col]), p[col], t), short=year)
    out["serial_number"] = chain((front & truthy(p["p5"]), p["p5"], none), (~front & truthy(p["s_number"]), p["s_number"], none))
    same = lambda g: front & (s["F_gender"] == g) & (s["I_gender"] == g)
    out["gender"] = chain((same("MALE"), F.lit("M"), none), (same("FEMALE"), F.lit("F"), none))
    return {k: F.when(p["qc"] <= 2, v) for k, v in out.items()}


def combined(passport_qc: Column, licence_qc: Column) -> Column:
    """struct(document_type, qc) of a page with both documents: badly read parts drop out; both give the mean rounded down."""
    bad_p, bad_l = F.coalesce(passport_qc >= 3, F.lit(True)), F.coalesce(licence_qc >= 3, F.lit(True))
    kind = F.when(bad_p & bad_l, 100).when(bad_p, 130).when(bad_l, 100).otherwise(140)
    qc = F.when(bad_p & bad_l, 4).when(bad_p, licence_qc).when(bad_l, passport_qc).otherwise(F.floor((passport_qc + licence_qc) / 2)).cast("int")
    return F.struct(kind.alias("document_type"), qc.alias("qc"))


def passport_qc(m: Column, top: list[Column], has_top: Column, bottom: list[Column], has_bottom: Column, serial: Column) -> Column:
    """3 if nothing was read; without a zone 2 if over half of the two pages' values are missing or a page is, else 1; with one
    0 if its last check holds, else 2."""
    values = [*top, *bottom]
    missing = sum((v.isNull().cast("int") for v in values), F.lit(0))
    nothing = m.isNull() & ~has_top & ~has_bottom & serial.isNull()
    return F.when(nothing, 3).when(m.isNull() & has_top & has_bottom, F.when(missing > len(values) / 2, 2).otherwise(1)).when(yes(m["final_check"]), 0).otherwise(2)


def licence_qc(checks: dict[str, Column], categories: Column) -> Column:
    """0 if all checks hold and there are categories, 1 with categories, else 2. The surname's check counts twice, that of the two dates not at all."""
    n = sum((yes(checks[k]).cast("int") for k in ("fam", "name", "fam", "birthplace3", "p4c", "p8")), F.lit(0))
    has = F.coalesce(F.size(categories) > 0, F.lit(False))
    return F.when((n == 6) & has, 0).when(has, 1).otherwise(2)
