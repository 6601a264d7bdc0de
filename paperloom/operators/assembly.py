"""Routing of pages, their envelopes, and the assembly of whole documents from what recognizers read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.operators import fuse
from paperloom.operators.fuse import truthy, yes

# --- routing ---


def restrict_to(kind: Column, allowed: Column) -> Column:
    """A type limited to the array of classes asked for, null or empty for all: 140 counts as the part that is asked for, others are 0."""
    has = lambda k: F.array_contains(allowed, k)
    part = F.when((kind == 140) & ~has(140), F.when(has(100), 100).when(has(130), 130))
    limited = F.coalesce(part, F.when(F.array_contains(allowed, kind), kind), F.lit(0))
    return F.when(F.coalesce(F.size(allowed), F.lit(0)) > 0, limited).otherwise(kind)


def route(barcodes_only: Column, allowed: Column, is_text: Column, bar: Column, text: Column, seen: Column) -> Column:
    """struct(document_type, way) of a page. Barcodes alone if only these are asked for; the classifier's type if classes are;
    else by the text gate: for texts the barcode's type, the rules' where it is 0, and the classifier's for other pages."""
    asked = F.coalesce(F.size(allowed), F.lit(0)) > 0
    by_bar = F.coalesce(bar, F.lit(0))
    way = F.when(yes(barcodes_only), "barcode").when(asked, "classes").when(~yes(is_text), "classes").when(by_bar > 0, "barcode").otherwise("text")
    kind = F.when(way == "barcode", by_bar).when(way == "text", F.coalesce(text, F.lit(0))).otherwise(restrict_to(F.coalesce(seen, F.lit(0)), allowed))
    return F.struct(kind.cast("int").alias("document_type"), way.alias("way"))


# --- envelopes ---


def merged(left: Column, right: Column) -> Column:
    """A map with the entries of both; the right one's win."""
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.array_contains(F.map_keys(right), k)), right)


def present(**fields: Column) -> Column:
    """A map of the fields, each of its own type, without those that are null."""
    entries = F.array(*[F.struct(F.lit(k).alias("k"), v.cast("variant").alias("v")) for k, v in fields.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def trusted_field(c: Column) -> Column:
    """A fused field, struct(value, value_short, trusted), as an object of what it has; null if it is null."""
    return F.when(c.isNotNull(), F.to_variant_object(present(value=c["value"], value_short=c["value_short"], trusted=c["trusted"])))


def envelope(kind: Column, description: Column, orientation: Column, parsed: Column, page: Column, error: Column | None = None) -> Column:
    """What is reported of a page: its type, description and orientation where known, overlaid with what the parser gave, then
    the page's number. A parser's error stands for what it would have given, with quality code 4."""
    if error is not None:
        failed = present(qc=F.lit(4), exception=F.concat(F.lit("ParserClass "), error))
        parsed = F.when(error.isNotNull(), failed).otherwise(parsed)
    return merged(merged(present(document_type=kind, description=description, text_doc_orientation=orientation), parsed), present(page=page))


def encoded(fields: Column) -> Column:
    """A map as JSON text, keys in order, values by their types; letters beyond ASCII stay as they are."""
    by_key = lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0)
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields), by_key)))


def final_page(page: Column, kind: Column, qc: Column, description: Column, passport: dict[str, Column], licence: dict[str, Column], parts_qc: tuple[Column, Column], categories: Column | None = None) -> Column:
    """What is reported of a page in the end, a map of typed values. page: its envelope, which passes whole if the type is none of the
    fused ones or the quality is unknown; its exception stays beside fused fields, and a licence's side. passport and licence: fused fields; a page
    with both has them as two objects with their own qualities parts_qc, without that of a part that is absent, whose quality is null.
    categories of a licence stand as they are. Quality 4 leaves type 0 and nothing else."""
    own = present(**{k: trusted_field(v) for k, v in passport.items()})
    drives = present(**{k: trusted_field(v) for k, v in licence.items()})
    if categories is not None:
        drives = merged(drives, present(categories=F.when(F.size(categories) > 0, F.to_variant_object(F.struct(categories.alias("value"))))))
    failed = F.map_filter(page, lambda k, v: (k == "exception") | ((k == "side") & (kind == 130)))
    part = lambda fields, quality: F.when(quality.isNotNull(), F.to_variant_object(merged(fields, present(qc=quality))))
    both = present(passport_main=part(own, parts_qc[0]), driving_license=part(drives, parts_qc[1]))
    fields = F.when(kind == 140, both).otherwise(merged(F.when(kind == 100, own).otherwise(drives), failed))
    fused = merged(present(document_type=kind, qc=qc, description=description), fields)
    known = F.coalesce(kind.isin(100, 130, 140), F.lit(False))
    return F.when(known & (qc < 4), fused).when(known & (qc == 4), present(document_type=F.lit(0), qc=F.lit(4))).otherwise(page)


def simplified(kind: Column, qc: Column) -> Column:
    """struct(document_type, qc, parts): which parts of a recognized page are fused, with quality 4 nothing but type 0; other pages pass as they are (parts null)."""
    known = kind.isin(100, 130, 140)
    parts = F.when(kind == 100, F.array(F.lit("passport"))).when(kind == 130, F.array(F.lit("licence"))).when(kind == 140, F.array(F.lit("passport"), F.lit("licence")))
    bad = known & (qc == 4)
    return F.struct(F.when(bad, 0).otherwise(kind).alias("document_type"), qc.alias("qc"), F.when(bad, F.array().cast("array<string>")).when(known & (qc < 4), parts).alias("parts"))


def filled(first: dict[str, Column], second: dict[str, Column]) -> dict[str, Column]:
    """Fields of one reading; where they are null, those of another, unless empty."""
    return {k: F.coalesce(v, F.when(truthy(second[k]), second[k])) for k, v in first.items()}


# --- passports ---


def zone_lines(lines: Column) -> Column:
    """Lines long enough to belong to a machine-readable zone."""
    return F.filter(lines, lambda x: F.length(x) > 40)


def passport(zone: Column, top: Column, bottom: Column, serial: Column, serial_checked: Column) -> dict[str, Column]:
    """The whole passport page: cross checks of the zone with the printed pages, serial number, quality code.

    zone: struct(f, i, o, s_number, gender, code, gender_check, final_check); top: struct(vidan, data_vid, code_pod); bottom:
    struct(F, I, O, gender, birth_date, birth_place); each null if absent. A name is checked if both readings agree and have two
    letters or more.
    """
    same = lambda z, b: yes(truthy(zone[z]) & (zone[z] == bottom[b]) & (F.length(zone[z]) > 1))
    gender = yes((zone["gender"] == "F") & (bottom["gender"] == "ЖЕН")) | yes((zone["gender"] == "M") & (bottom["gender"] == "МУЖ"))
    code = yes(F.regexp_replace(top["code_pod"], "[^0-9]", "") == zone["code"])
    tops = [top["vidan"], top["data_vid"], top["code_pod"], F.lit(False)]
    bottoms = [bottom[k] for k in ("F", "I", "O", "gender", "birth_date", "birth_place")]
    read = truthy(serial)
    in_zone = zone.isNotNull()
    return {
        "qc": fuse.passport_qc(zone, tops, top.isNotNull(), bottoms, bottom.isNotNull(), F.when(read, serial)),
        "f_check": F.when(in_zone, same("f", "F")), "i_check": F.when(in_zone, same("i", "I")), "o_check": F.when(in_zone, same("o", "O")),
        "gender_check": F.when(in_zone, yes(zone["gender_check"]) | gender),
        "serial_number": F.when(read, serial), "serial_number_check": read & (yes(serial_checked) | yes(serial == zone["s_number"])),
        "code_pod_check": F.when(top.isNotNull(), code),
    }


def suggestion_ways(zone: Column, bottom: Column) -> dict[str, Column]:
    """How each name is looked up: struct(way, first, second). Surname and name by both readings if there are two, else by the
    one there is; the patronymic by the zone's, else the printed one. Null if nothing was read."""
    def ask(z: Column, b: Column, double: bool) -> Column:
        both = truthy(z) & truthy(b) if double else F.lit(False)
        none = F.lit(None).cast("string")
        way = lambda w, x, y: F.struct(F.lit(w).alias("way"), x.alias("first"), y.alias("second"))
        one, other = (b, z) if double else (z, b)
        return F.when(yes(both), way("double", z, b)).when(yes(truthy(one)), way("retry", one, none)).when(yes(truthy(other)), way("retry", other, none))

    return {n: ask(zone[n.lower()], bottom[n], n != "O") for n in "FIO"}


# --- licences ---

#: Attempts to read a licence; templates of the front come first.
ATTEMPTS, FRONT_TEMPLATES = 3, 2


def best_template(counts: Column) -> Column:
    """0-based place of the template with the most matches, the first of equals; null if none matches."""
    top = F.array_max(counts)
    return F.when(top > 0, F.array_position(counts, top) - 1).cast("int")


def chosen_attempt(qcs: Column) -> Column:
    """0-based number of the attempt that counts: the first that is good, quality code 0 or 1, else the last of three."""
    tried = F.slice(qcs, 1, ATTEMPTS)
    good = F.filter(F.transform(tried, lambda q, i: F.when(q < 2, i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(good, F.lit(0)), F.size(tried) - 1)


def licence(counts: Column, front_qc: Column, back_serial: Column) -> Column:
    """struct(side, qc, exception) of one attempt: the front's quality code is that of its fields, null if no text was found on
    it; a back with a serial number has 1; all failures have 4 and a message."""
    best = best_template(counts)
    front, back = best < FRONT_TEMPLATES, best >= FRONT_TEMPLATES
    # fixed values: the messages
    said = F.when(best.isNull(), "Fail to match driver license to templates.").when(front & front_qc.isNull(), "Fail to detect front side of Driving License.").when(back & back_serial.isNull(), "Fail to detect back side of Driving License.")
    qc = F.when(said.isNotNull(), 4).when(front, front_qc).otherwise(1)
    return F.struct(F.when(said.isNull(), F.when(front, "front").otherwise("back")).alias("side"), qc.cast("int").alias("qc"), said.alias("exception"))


def reading_attempt(letters: Column, amount: int) -> Column:
    """0-based number of the preparation that is read: of ten at most the first with more than `amount` letters, else that with
    the most, the first of equals; null if even that has under half of `amount`."""
    tried = F.slice(letters, 1, 10)
    over = F.filter(F.transform(tried, lambda n, i: F.when(n > amount, i)), lambda i: i.isNotNull())
    most = F.array_max(tried)
    return F.when(most >= amount / 2, F.when(most > 0, F.coalesce(F.get(over, F.lit(0)), (F.array_position(tried, most) - 1).cast("int"))))


# --- handwriting ---

# Layouts by document type. Of static layouts, by which coordinate rectangles are ordered, and each field's
# rectangles, any of which will do; of variable ones, rectangles (x, height above the lowest text, width, height), on pages before
# the last and on the last.
STATIC = {10: ("y", {"signature1": (0,)}), 45: ("y", {"signature1": (1, 2)}), 42: ("x", {"signature1": (0,), "signature2": (1,)}), 40: ("y", {"signature1": (1,), "signature2": (3,), "some_text_field": (0,), "FIO": (2,)})}
STATIC_PAGES = {40: 3}
VARIABLE = {
    46: (((40, 100, 300, 150), (500, 100, 300, 150)), ((50, 150, 200, 70), (530, 150, 170, 70), (750, 90, 170, 70))),
    43: (None, ((40, 230, 300, 120), (600, 230, 300, 120))),
    41: (None, ((40, 100, 300, 150), (500, 100, 300, 150))),
}


def ordered_rectangles(rects: Column, kind: Column) -> Column:
    """A layout's rectangles (x, y, w, h) from top to bottom, or from left to right where the layout says so; equals keep their order."""
    by_x = kind.isin([k for k, (by, _) in STATIC.items() if by == "x"])
    keyed = F.transform(rects, lambda r, i: F.struct(F.when(by_x, r["x"]).otherwise(r["y"]).alias("at"), i.alias("i"), r.alias("r")))
    return F.transform(F.array_sort(keyed), lambda k: k["r"])


def signature_rectangles(kind: Column, page: Column, pages: Column, lowest: Column) -> Column:
    """Rectangles (x, y, w, h) of the signatures of a variable layout above its lowest text; null if the page has none."""
    out = F.lit(None).cast("array<struct<x:int,y:int,w:int,h:int>>")
    for k, (before, last) in VARIABLE.items():
        for rects, here in ((before, ~yes(page == pages)), (last, yes(page == pages))):
            if rects:
                made = F.array(*[F.struct(F.lit(x).alias("x"), (lowest - up).cast("int").alias("y"), F.lit(w).alias("w"), F.lit(h).alias("h")) for x, up, w, h in rects])
                out = F.when((kind == k) & here, made).otherwise(out)
    return out


def handwriting(kind: Column, page: Column, pages: Column, pieces: Column) -> Column:
    """struct(qc, text_doc_fields): which fields of a page are filled in. pieces: for each rectangle, in the layout's order, the gate's
    answers for its pieces, one at least; null where the layout wasn't found. qc 1 and null fields if nothing was asked for."""
    any_of = lambda at: F.exists(F.flatten(F.array(*[F.get(pieces, F.lit(i)) for i in at])), lambda b: yes(b))
    fields = F.lit(None).cast("map<string,boolean>")
    for k, (_, parts) in STATIC.items():
        made = F.create_map(*[x for name, at in parts.items() for x in (F.lit(name), any_of(at))])
        fields = F.when((kind == k) & (yes(page == STATIC_PAGES[k]) if k in STATIC_PAGES else F.lit(True)), made).otherwise(fields)
    for k, (before, last) in VARIABLE.items():
        for rects, here in ((before, ~yes(page == pages)), (last, yes(page == pages))):
            if rects:
                made = F.create_map(*[x for i in range(len(rects)) for x in (F.lit(f"signature{i + 1}"), any_of((i,)))])
                fields = F.when((kind == k) & here, made).otherwise(fields)
    fields = F.when(pieces.isNotNull(), fields)
    return F.struct(F.when(fields.isNull(), 1).otherwise(0).alias("qc"), fields.alias("text_doc_fields"))


# --- files, boxes, results ---


def page_files(files: DataFrame, job: str, path: str, most: int = 100) -> DataFrame:
    """files with page_num, the place of a job's page by its path's characters, and exception where a job has `most` files or more."""
    per_job = W.partitionBy(job)
    f = files.withColumn("page_num", F.row_number().over(per_job.orderBy(path)) - 1).withColumn("_n", F.count("*").over(per_job))
    return f.withColumn("exception", F.when(F.col("_n") >= most, "ValueError")).drop("_n")


def scaled_box(box: Column, edge: Column, xs: Column, ys: Column) -> Column:
    """A box (x, y, w, h) of a small image without its edge, in the large image: half-way values go to the even number."""
    return F.struct(*[F.bround(v).cast("int").alias(n) for n, v in (("x", (box["x"] + edge) * xs), ("y", (box["y"] + edge) * ys), ("w", box["w"] * xs), ("h", box["h"] * ys))])


def point_reads(asked: DataFrame, results: DataFrame, key: str = "job_id") -> DataFrame:
    """The answers to requests (key): code 400 without a key, 404 for an unknown one, else 200 with the payload of results (key, payload)."""
    r = results.select(F.col(key).alias("_k"), "payload")
    found = asked.join(r, asked[key] == r["_k"], "left")
    code = F.when(F.coalesce(F.col(key).cast("string"), F.lit("")) == "", 400).when(F.col("_k").isNull(), 404).otherwise(200)
    return found.select(key, code.alias("code"), F.when(code == 200, F.col("payload")).alias("payload"))


def log_line(job: Column, message: Column) -> Column:
    """A message with its job's prefix."""
    return F.concat(job, F.lit(":"), message)
