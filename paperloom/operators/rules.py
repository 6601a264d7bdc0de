"""Page types from recognized text: an ordered table of containment rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions.text import normalise

_NOT_CONTRACT = ("ПРИЛОЖЕНИЕ", "ОСНОВАНИЕПОДОГОВОРУ", "ОПЛАТАПОДОГОВОРУ", "СОГЛАСНОДОГОВОРУ", "СЧЕТНАОПЛАТУ")
# Fixed values: (all of these, at least half of these, none of these, type, description), in the order of declaration.
RULES = (
    (("ЗАКЛЮЧЕНИЕПОКРЕДИТНОЙЗАЯВКЕ",), (), (), 80, "Заключение андеррайтера"),
    (("ПРОФЕССИОНАЛЬНОЕСУЖДЕНИЕПООЦЕНКЕКРЕДИТНОГОРИСКАПОССУДЕ",), (), (), 1, "Профессиональное суждение по оценке кредитного риска по ссуде"),
    (("ОЦЕНКАФИНАНСОВОГОПОЛОЖЕНИЯ",), (), (), 2, "Оценка финансового положения"),
    ((), ("АСИЕЗАЕМЩИКАН", "НАОБРАБОТКУМОИХПЕРСОНАЛЬНЫХДАННЫХ"), ("УСЛОВИЕОБУСТУПКЕ", "ЦЕЛИИСПОЛЬЗОВАНИЯЗАЕМЩИКОМ"), 10, "Согласие на обработку персональных данных"),
    (("ДОГОВОР", "КУПЛИПРОДАЖИ"), (), (*_NOT_CONTRACT, "ЗАЕМЩИКСОГЛАСЕНСТЕМЧТОВСЛУЧ", "АЕНЕСОГЛАСИЯЗАЧЕРКНУТЬ", "ПОРЯДОКПРИЕМАПЕРЕДАЧИТРАНСПОРТНОГОСРЕДСТВА", "СТВАНЕПРЕОДОЛИМОЙСИЛ", "ПРИНЦИПАЛОБЯЗАН", "ДОПОЛНИТЕЛЬНЫЕУСЛОВИЯ"), 11, "Договор купли продажи"),
    (("ДОГОВОРКОМИССИИ", "ПРЕДМЕТДОГОВОРА"), (), _NOT_CONTRACT, 12, "Договор комиссии"),
    (("АГЕНТСКИЙДОГОВОР", "ПРЕДМЕТДОГОВОРА"), (), _NOT_CONTRACT, 13, "Агентский договор"),
    (("АКТПРИЕМАПЕРЕДАЧИ",), (), ("ПОРЯДОКПРИЕМАПЕРЕДАЧИ", "ФОРСМАЖОР", "ПОРЯДОКИЗМЕНЕНИЯИДОПОЛНЕНИЯДОГОВОРА", "ПОРЯДОКРАЗРЕШЕНИЯСПОРОВ"), 20, "Акр приема-передачи"),
    (("ПРИЕМОСДАТОЧНЫЙАКТ",), (), (), 21, "Приемо-сдаточный акт"),
    (("СЧЕТ№",), ("ПОЛУЧАТ", "УЧАТЕЛЬ", "ПОСТАВЩИК", "ОПЛАТА"), (), 22, "Счет"),
    (("СЧЕГ№",), ("ПОЛУЧАТ", "УЧАТЕЛЬ", "ПОСТАВЩИК", "ОПЛАТА"), (), 22, "Счет"),
    (("СЧЕТНАОПЛАТУ№", "ИНН"), (), (), 22, "Счет"),
    (("КВИТАНЦИЯ", "РИНЯТООТ"), (), (), 23, "Квитанция"),
    (("ПОЛИС№", "КАСКО", "ДОГОВОРАСТРАХОВАНИЯ", "СТРАХОВАТЕЛЬ"), (), (), 24, "Страховой полис КАСКО"),
    (("ПОЛИСКОМПЛЕКСНОГОСТРАХОВАНИЯТРАНСПОРТНОГОСРЕДСТВА", "СТРАХОВАТЕЛЬ"), (), (), 24, "Страховой полис КАСКО (КТС)"),
    (("ДОГОВОРПОРУЧЕНИЯ",), (), _NOT_CONTRACT, 26, "Договор поручения"),
    (("ВЫПИСКАИЗЭЛЕКТРОННОГОПАСПОРТА",), (), (), 27, "Выписка из электронного паспорта"),
    (("АНКЕТАКЛИЕНТАФИЗИЧЕСКОГОЛИЦА",), (), (), 28, "Анкета клиента физлица у партнера"),
    (("ЭЛЕКТРОННАЯКАРТА", "НАДОРОГЕ", "ПОДДЕРЖК"), (), (), 29, "Карта технической помощи на дороге"),
    (("АНКЕТАЗАЕМЩИКАФИЗИЧЕСКОГОЛИЦА",), (), (), 40, "Анкета клиента - заемщика банка"),
    (("ЗАЯВЛЕНИЕНАПЕРЕВОДДЕ",), (), (), 41, "Заявление на перевод денежных средств со счета ФЛ"),
    (("ЗАЯВЛЕНИЕОЗАРАНЕЕДАН",), (), (), 42, "Заявление о заранее данном акцепте ФЛ"),
    (("ЗАЯВЛЕНИЕОПРЕДОСТАВЛЕНИИКРЕДИТА",), (), (), 43, "Заявление о предоставлении кредита"),
    (("КПРАВИЛАМДИСТАНЦИОННОГОБАНКОВСКОГООБСЛУЖИВАНИЯ",), (), (), 44, "Заявление о подключении онлайн-сервисов РУСНАРБАНК"),
    (("ЛОГИНАДЛЯДОСТУПАКСИСТЕМЕ",), (), (), 45, "Извещение о присвоении логина"),
    (("ПОЛНАЯСТОИМОСТЬКРЕДИТА", "ИНДИВИДУАЛЬНЫЕУСЛОВИЯ"), (), (), 46, "Индивидуальные условия"),
    (("РАСПОРЯЖЕНИЕОПРЕДОСТАВЛЕНИИКРЕДИТА",), (), (), 47, "Распоряжение о предоставлении кредита"),
    (("СЕРТИФИКАТНАСТОЯЩИМСЕРТИФИКАТОМКОММЕРЧЕСКИЙБ",), (), (), 48, "Одобрение - сертификат"),
    (("СПОСОБЫПОГАШЕНИЯКРЕДИТА",), (), (), 50, "Способы погашения кредита"),
    (("ГАРАНТИЙНОЕПИСЬМО",), (), (), 51, "Гарантийное письмо - в автосалон за автомобиль/за дополнительное оборудование"),
    (("СПИСАНОСОСЧПЛА", "ПОРУЧЕНИЕ"), (), (), 53, "Платежное поручение - Основной платежный документ/на оплату КАСКО/на оплату дополнительного оборудования"),
    (("ПОЛИССТРАХОВАНИЯЖИЗНИ",), (), (), 56, "Полис страхования от несчастного случая"),
    (("ПОЛИССТРАХОВАНИЯОТПОТЕРИРАБОТЫ",), (), (), 57, "Полис страхования от потери работы"),
    (("ПАМЯТКАКДОГОВОРАМЛИЧНОГОСТРАХОВАНИЯ",), (), (), 58, "Памятка к договорам личного страхования"),
    (("ЗАЯВЛЕНИЕНАУЧАСТИЕВГОСУДАРСТВЕННОЙПРОГРАММЕ",), (), (), 59, "Заявление на участие в государственной программе"),
    ((), (), (), 60, "ТЕЛЕМЕДИЦИНА"),
    (("ЗАЯВЛЕНИЕОПРИСОЕДИНЕНИИКДОГОВОРУКОМПЛЕКСНОГОБАНКО",), (), (), 61, "ЗАЯВЛЕНИЕ О ПРИСОЕДИНЕНИИ К ДОГОВОРУ КОМПЛЕКСНОГО БАНКОВСКОГО ОБСЛУЖИВАНИЯ ФИЗИЧЕСКИХ ЛИЦ"),
    ((), ("ПАСПОРТТРАН", "ГОСРЕДСТ", "ОСОБЫЕОТМЕТКИ", "ИДЕНТИФИКАЦИОННЫЙНО", "ГОСУДАРСТВЕННЫЙРЕГИСТРАЦИОННЫЙЗНАК", "ВЫДАНОГИБДД"), (), 110, "ПТС front. Пасспорт транспортного средства - первая."),
    ((), ("ОСОБЫЕОТМЕТКИ", "СВИДЕТЕЛЬСТВООРЕГИСТРАЦИИТ", "РЕГИСТРАЦИОННЫЙЗНАК", "ДАТАРЕГИСТРАЦИИ", "ДАТАПРОДАЖИПЕРЕДАЧИ"), (), 110, "ПТС back. Пасспорт транспортного средства - вторая."),
    (("ТИПЗАПРАШИВАЕМОГОКРЕДИТА", "ЗАПРАШИВАЕМАЯСУММАКРЕДИТА"), ("АВТОСПЕЦЦЕНТР", "РОЛЬВПРЕДПОЛАГАЕМОЙСДЕЛКЕ"), (), 501, "Анкета-заявление на предоставление кредита. АвтоСпецЦентр"),
    (("КАПИТАЛ", "ЗАЯВЛЕНИЕОСТРАХОВАНИИ", "МЕННЫЙЗАПРОС"), (), (), 510, "КАПЛАЙФ Заявление о страховании"),
    (("КАПИТАЛ", "ПОЛИС№"), (), (), 511, "КАПЛАЙФ Заявление о страховании"),
    (("ТАБЛИЦАРАЗМЕРОВСТРАХОВЫХСУММ",), (), (), 512, "Таблица размеров страховых сумм"),
    (("КАПИТАЛ", "ПАМЯТКАВАЖНЫЕПОЛОЖЕНИЯ"), (), (), 513, "КАПЛАЙФ Памятка Важные положения договора страхования"),
    (("КАПИТАЛ",), ("ПРОГРАММАДОБРОВ", "ОЛЬНОГОИНДИВИДУ", "АЛЬНОГОСТРАХ", "ОВАНИЯЗАЁМЩ", "ИКОВКРЕДИТАДЛЯКЛИЕНТОВ"), (), 514, "КАПЛАЙФ Программа добровольного индивидуального страхования заёмщиков кредита для клиентов АО КБ «РУСНАРБАНК»"),
    (("С", "О", "Г", "А", "З"), ("НАСТОЯЩИМПО", "ЛИСОМОФЕРТОЙДА", "ПОЛИСОФЕРТАСТРАХОВАНИЯОТН", "ЕСЧАСТНЫХСЛУЧАЕВИБОЛЕЗНЕЙ"), (), 520, "СОГАЗ Заявление о страховании (полис-оферта)"),
    (("ТАБЛИЦАСТРАХОВЫХВЫПЛАТПРИТЕЛЕСНЫХПОВРЕЖДЕНИЯХ", "ПРИЛОЖЕНИЕ"), ("ЗАСТРАХОВАННОГОЛИЦАВРЕЗУ", "ЛЬТАТЕНЕСЧАСТНОГОСЛУЧАЯ"), (), 521, "СОГАЗ Таблица страховых выплат при телесных повреждениях"),
    (("СОГАЗ", "ПАМЯТКА"), ("ПОЛИСОФЕРТАСТРАХОВАНИЯОТН", "ЕСЧАСТНЫХСЛУЧАЕВИБОЛЕЗНЕЙ"), (), 522, "СОГАЗ Памятка к заявлению о страховании"),
)
# Types whose further pages carry no sign of their own; how many pages they have in all, 0 for any number.
CONTINUED = {80: 2, 11: 0, 12: 0, 13: 0, 24: 0, 26: 0, 28: 0, 29: 0, 40: 2, 46: 0, 56: 3, 511: 0, 514: 0, 520: 0}


def by_priority(rules: tuple = RULES) -> list[tuple]:
    """Rules with more required words first, in order of declaration among equals."""
    return sorted(rules, key=lambda r: -len(r[0]))


def half(n: int) -> int:
    """Half of n, rounded to the even neighbour."""
    return round(n / 2)


def type_table(spark: SparkSession) -> DataFrame:
    """(doc_id, description): one row for each type; the last description counts."""
    return spark.createDataFrame(sorted({r[3]: r[4] for r in RULES}.items()), "doc_id long, description string")


def hits(text: Column, rule: tuple) -> Column:
    must, several, never, *_ = rule
    ok = F.lit(True)
    for w in must:
        ok = ok & F.contains(text, F.lit(w))
    for w in never:
        ok = ok & ~F.contains(text, F.lit(w))
    if half(len(several)):
        some = sum((F.contains(text, F.lit(w)).cast("int") for w in several), F.lit(0))
        ok = ok & (some >= half(len(several)))
    return ok


def classify(text: Column, rules: tuple = RULES, strict: bool = True) -> Column:
    """struct(document_type, description) of the first rule that normalised text meets; null if none does.

    One pass, no join: the rules are a fixed chain of conditions. strict keeps the rule without conditions, which
    takes every text that reaches it; without it, rules after it can apply too.
    """
    out = None
    for r in by_priority(rules):
        if not strict and not any(r[:3]):
            continue
        got = F.struct(F.lit(r[3]).cast("long").alias("document_type"), F.lit(r[4]).alias("description"))
        out = F.when(hits(text, r), got) if out is None else out.when(hits(text, r), got)
    return out


def classify_turns(ocr: DataFrame, page: list[str], rules: tuple = RULES, strict: bool = True) -> DataFrame:
    """ocr (page keys, turn, text) of quarter turns in order: texts add up until a rule applies. One row for each page
    with document_type (0 if none), description and turns, the turn that decided (null if none)."""
    w = W.partitionBy(*page).orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    so_far = ocr.withColumn("so_far", F.array_join(F.collect_list(F.coalesce(normalise(F.col("text")), F.lit(""))).over(w), ""))
    typed = so_far.withColumn("t", F.when(F.col("so_far") != "", classify(F.col("so_far"), rules, strict)))
    first = F.min_by(F.struct("t", "turn"), F.when(F.col("t").isNotNull(), F.col("turn")))
    return typed.groupBy(*page).agg(first.alias("f")).select(*page, F.coalesce("f.t.document_type", F.lit(0).cast("long")).alias("document_type"), F.col("f.t.description").alias("description"), F.when(F.col("f.t").isNotNull(), F.col("f.turn")).alias("turns"))


def restrict(kind: Column, allowed: list[int] | None) -> Column:
    """A type limited to the classes asked for: the combined type counts as one of its parts, others become 0."""
    if allowed is None:
        return kind
    part = next((p for p in (100, 130) if p in allowed and 140 not in allowed), None)
    out = F.when((kind == 140) & F.lit(part is not None), F.lit(part or 0))
    return out.when(kind.isin(allowed), kind).otherwise(0)


def class_type(cls: Column, sub: Column) -> Column:
    """Page type of a classifier's class and subclass (0 main, other values not)."""
    main = sub == "passport_main"
    return F.when(cls == 0, F.when(main, 100).otherwise(101)).when(cls == 1, 110).when(cls == 2, 120).when(cls == 3, 130).otherwise(F.when(main, 140).otherwise(130))


def parser_of(kind: Column) -> Column:
    """Which parser a page goes to."""
    return (
        F.when(kind == 0, "unknown").when(kind == 100, "passport").when(kind == 130, "licence").when(kind == 140, "combined")
        .when(kind.isin(101, 120), "skip").when(kind.isin(10, 40, 41, 42, 43, 45, 46), "handwriting").otherwise("common")
    )
