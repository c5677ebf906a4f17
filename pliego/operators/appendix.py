"""Fields of tender documents, found by their headings; records of documents with a status.

A text becomes line rows once. Lines that name a field (any of its heading variants as whole
words) are hits; a hit's window runs to the next heading line, up to a number of signs. A
field takes its richest window, headings first. Only texts that hold the first word of some
variant are cut into lines, and their rows move once, by text: pages, sections and offsets
are running values over a text's lines, and windows come from pieces of sections, so the
work for a hit is bounded by the window's size.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.notices import let
from ..functions.semantics import fold_plain
from . import appendix_tables as T

WINDOW, VALUE, EXCERPT, HEADING = 4000, 2500, 500, 120
_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85  ]"
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"


def _trimmed(c: Column) -> Column:
    return F.trim(c, F.lit(_SPACES))


def _norm(c: Column) -> Column:
    return F.trim(F.regexp_replace(fold_plain(c), r"(?U)\s+", " "))


def is_contents_line(raw: Column) -> Column:
    """A line of a table of contents: a leader of dots, or dots before a page number at the end."""
    return raw.rlike(r"\.{4,}") | _trimmed(raw).rlike(r"\.{2,}\s*[0-9]{1,4}$")


def is_section_line(raw: Column) -> Column:
    """Whether a line begins a section: numbered, lettered, or short and mostly in capitals."""
    text = _trimmed(raw)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace(text, r"[^\p{L}]|\p{Ll}", ""))
    formed = raw.rlike(r"^\s*[0-9]{1,2}(?:\.[0-9]{1,2})*\s*[.\-)]?\s+\S") | text.rlike(r"^[A-Z]\.?\s*[0-9]{0,2}\.?\s+[A-ZÁÉÍÓÚÑ]") | text.rlike(r"^[A-Z][).]\s+\S")
    return (F.length(text) > 0) & (F.length(text) <= 130) & (formed | ((letters >= 4) & (capitals >= 0.7 * letters)))


def is_pointer(window: Column) -> Column:
    """A window with little prose, or of leaders mostly: it points at a field and does not state it."""
    letters, dots = F.length(F.regexp_replace(window, r"[^\p{L}]", "")), F.length(F.regexp_replace(window, r"[^.]", ""))
    return (letters < 25) | ((dots >= 20) & (letters < 0.45 * F.length(window)))


def _first_words(variants: Mapping[str, Sequence[str]]) -> str:
    return "|".join(sorted({re.escape(re.split(r"\W", v)[0]) for vs in variants.values() for v in vs}))


def _named(raw: Column, variants: Mapping[str, Sequence[str]]) -> Column:
    """The fields that a line names: the first place of a variant in it has no letter or digit on either side."""
    table = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(v).alias("variant")) for f, vs in variants.items() for v in vs))

    def whole(line: Column, variant: Column) -> Column:
        def alone(at: Column) -> Column:
            before, after = F.substr(line, F.greatest(at - 1, F.lit(1)), F.lit(1)), F.substr(line, at + F.length(variant), F.lit(1))
            return (at > 0) & ((at == 1) | ~before.rlike(r"[\p{L}\p{N}]")) & ~after.rlike(r"[\p{L}\p{N}]")

        return let(F.position(variant, line), alone)

    def named(line: Column) -> Column:
        hits = F.filter(table, lambda x: F.contains(line, x["variant"]))
        return F.array_distinct(F.transform(F.filter(hits, lambda x: whole(line, x["variant"])), lambda x: x["field"]))

    return F.when(fold_plain(raw).rlike(_first_words(variants)), let(_norm(raw), named)).otherwise(F.array().cast("array<string>"))


def section_lines(docs: DataFrame, ident: str, text: str, variants: Mapping[str, Sequence[str]] = T.VARIANTS, window: int = WINDOW) -> DataFrame:
    """(ident, line_no, raw, head, contents, fields, page, section, start), the lines of texts that may name a field.

    Page markers are left out, the page of a line is that of the last one above it, 1 before
    the first. section counts the heading lines so far; start is the line's offset in the
    text, each line counted up to ``window`` signs.
    """
    held = docs.select(ident, F.col(text).alias("_t")).where(fold_plain(F.col("_t")).rlike(_first_words(variants)))
    rows = held.select(ident, F.posexplode(F.split("_t", _BREAK)).alias("line_no", "raw"))
    mark = F.regexp_extract(_trimmed(F.col("raw")), r"(?i)^---\s*PAGE\s+([0-9]+)\s*---$", 1)
    rows = rows.withColumn("mark", mark).withColumns({"head": (F.col("mark") == "") & is_section_line(F.col("raw")), "blank": _trimmed(F.col("raw")) == ""})
    w = Window.partitionBy(ident).orderBy("line_no")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    counted = F.when(F.col("mark") == "", F.least(F.length("raw"), F.lit(window)) + 1).otherwise(0)
    page = F.last(F.when(F.col("mark") != "", F.col("mark").try_cast("int")), ignorenulls=True).over(so_far)
    rows = rows.withColumns({"page": F.coalesce(F.nullif(page, F.lit(0)), F.lit(1)), "section": F.sum(F.col("head").cast("int")).over(so_far), "start": F.sum(counted).over(so_far) - counted})
    rows = rows.where("mark = ''").withColumn("contents", is_contents_line(F.col("raw")))
    real = Window.partitionBy(ident, "blank").orderBy("line_no")
    rows = rows.withColumn("contents", F.col("contents") | F.coalesce(F.lead("contents").over(real), F.lit(False)))
    return rows.select(ident, "line_no", "raw", "head", "contents", _named(F.col("raw"), variants).alias("fields"), "page", "section", "start")


def field_windows(docs: DataFrame, ident: str, text: str, variants: Mapping[str, Sequence[str]] = T.VARIANTS, window: int = WINDOW) -> DataFrame:
    """(ident, field, value, excerpt, page, heading, method, confidence, only_pointer, truncated): the best window of each field that a text names.

    The best has the most signs that are no dots, 400 more on a heading line; the first on a
    tie. A field named only in the table of contents, or whose best window is a pointer, is
    reported as one, with its line as value. Null and empty texts give no rows; two rows of
    one ident are read as one text each only if idents differ, so give each text its own.
    """
    rows = section_lines(docs, ident, text, variants, window)
    line = F.struct("line_no", F.left("raw", F.lit(window)).alias("raw"), "head", "contents", "fields", "page", F.when(F.size("fields") > 0, _trimmed(F.col("raw"))).alias("text"))
    pieces = rows.groupBy(ident, "section", F.floor(F.col("start") / window).alias("piece")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    w = Window.partitionBy(ident, "section").orderBy("piece")
    near = lambda k: F.when(F.lead("piece", k).over(w) <= F.col("piece") + 2, F.lead("lines", k).over(w))
    nothing = F.filter("lines", lambda _: F.lit(False))
    pieces = pieces.withColumns({"one": near(1), "two": near(2)}).where(F.exists("lines", lambda x: F.size(x["fields"]) > 0))
    pieces = pieces.withColumn("raws", F.concat("lines", F.coalesce("one", nothing), F.coalesce("two", nothing)))
    hits = pieces.select(ident, "raws", F.explode(F.filter("lines", lambda x: F.size(x["fields"]) > 0)).alias("hit"))
    behind = F.array_join(F.transform(F.filter("raws", lambda x: x["line_no"] > F.col("hit.line_no")), lambda x: x["raw"]), "\n")
    hits = hits.withColumn("behind", behind).drop("raws")
    body = _trimmed(F.left("behind", F.lit(window)))
    hits = hits.select(
        ident, F.explode("hit.fields").alias("field"), "hit.line_no", "hit.head", "hit.contents", "hit.page", "hit.text", F.length("behind") + 1 > window,
        _trimmed(F.when(body == "", F.col("hit.text")).otherwise(F.concat("hit.text", F.lit("\n"), body))),
    ).toDF(ident, "field", "line_no", "head", "contents", "page", "text", "cut", "window")
    score = F.when(F.col("contents"), 0).otherwise(F.length(F.regexp_replace("window", r"\.", "")) + F.when(F.col("head"), 400).otherwise(0))
    best = F.max_by(F.struct("head", "contents", "page", "text", "cut", "window"), F.struct(~F.col("contents"), score, -F.col("line_no")))
    found = hits.groupBy(ident, "field").agg(best.alias("b")).select(ident, "field", "b.*")
    found = found.withColumn("only_pointer", F.col("contents") | is_pointer(F.col("window")))
    label = _trimmed(F.regexp_replace("text", r"\.{2,}.*$", ""))
    shown = F.when(F.col("only_pointer"), label).otherwise(F.col("window"))
    size = F.length("window")
    confidence = F.when(F.col("only_pointer"), "low").when(F.col("head") & (size > 200), "high").when(size > 120, "medium").otherwise("low")
    return found.select(
        ident, "field", F.left(shown, F.lit(VALUE)).alias("value"), shown.alias("excerpt"), "page", F.left(F.when(F.col("only_pointer"), label).otherwise(F.col("text")), F.lit(HEADING)).alias("heading"),
        F.when(F.col("only_pointer") | F.col("head"), "heading_window").otherwise("keyword_window").alias("method"), confidence.alias("confidence"),
        "only_pointer", (~F.col("only_pointer") & (F.col("cut") | (size > VALUE))).alias("truncated"),
    )


def classification_code(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """The columns of field_windows for the first CPV code of each text that has one, with the first line that holds it."""
    found = F.regexp_extract(text, r"(?i)\bcpv\b[:\s]*([0-9]{6,8}(?:-[0-9])?)", 0)
    code = F.regexp_extract(text, r"(?i)\bcpv\b[:\s]*([0-9]{6,8}(?:-[0-9])?)", 1)
    rows = docs.select(ident, F.col(text).alias("_t"), found.alias("_found"), code.alias("_code")).where("_code <> ''")
    line = F.get(F.filter(F.split("_t", _BREAK), lambda x: F.contains(x, F.col("_code"))), F.lit(0))
    shown = F.coalesce(F.nullif(_trimmed(line), F.lit("")), F.col("_found"))
    return rows.select(
        ident, F.lit("cpv").alias("field"), F.col("_code").alias("value"), shown.alias("excerpt"), F.lit(1).alias("page"), F.lit("CPV").alias("heading"), F.lit("regex").alias("method"), F.lit("medium").alias("confidence"),
        F.lit(False).alias("only_pointer"), F.lit(False).alias("truncated"),
    )


def document_fields(docs: DataFrame, ident: str, text: str, variants: Mapping[str, Sequence[str]] = T.VARIANTS) -> DataFrame:
    """field_windows of all fields; the classification code is looked for as a code, not as a heading."""
    found = field_windows(docs, ident, text, {f: v for f, v in variants.items() if f != "cpv"})
    return found.unionByName(classification_code(docs, ident, text)) if "cpv" in variants else found


def _link(role: str) -> Column:
    """The first document with a link, those of the role first."""
    linked = F.col("_in") & ((F.coalesce("url", F.lit("")) != "") | (F.coalesce("final_url", F.lit("")) != ""))
    return F.min_by(F.struct("url", "final_url", "label", "role"), F.when(linked, F.struct(F.col("role") != role, "position")))


def record_fields(
    docs: DataFrame, record: str, variants: Mapping[str, Sequence[str]] = T.VARIANTS, roles: Mapping[str, Sequence[str]] = T.ROLES, core: Sequence[str] = T.CORE, excerpt: int = EXCERPT
) -> tuple[DataFrame, DataFrame]:
    """Fields and status of records, from their documents (record, position, role, text, chars, pages, url, final_url, label).

    Documents of other roles do not count; a role has its own fields. Fields are looked for
    in usable texts: not missing (null), empty, or long with little text. Of several documents
    the most confident wins, the first on a tie; position tells a record's documents apart.

    fields: (record, field, field_status, value, confidence, page, heading, method, excerpt,
    position, url, final_url, truncated, fallback), one row for each field of the roles; a field
    without evidence has a fallback (mode, label, url, final_url, reason).
    records: (record, record_status, fields_extracted, fields_missing, warnings, badge,
    show_fields, manual_review, ocr_needed, message), one row for each record in docs.
    """
    every = list(dict.fromkeys(f for fields in roles.values() for f in fields))
    chars, pages = F.coalesce("chars", F.lit(0)), F.coalesce("pages", F.lit(0))
    sparse = (pages >= 10) & ((F.round(F.try_divide(chars, pages), 1) < 150) | (chars < 1500))
    quality = F.when(F.col("text").isNull(), "missing").when(chars == 0, "empty").when(sparse, "low_coverage").otherwise("usable")
    docs = docs.withColumn("_in", F.coalesce(F.col("role").isin(*roles), F.lit(False))).withColumn("_quality", F.when(F.col("_in"), quality)).withColumn("_ocr", F.col("_quality").isin("empty", "low_coverage"))
    usable = docs.where("_quality = 'usable'").select(F.struct(record, "position", "role").alias("_doc"), "text")
    allowed = F.coalesce(*(F.when(F.col("_doc.role") == r, F.array(*map(F.lit, fs))) for r, fs in roles.items()))
    found = document_fields(usable, "_doc", "text", variants).where(F.array_contains(allowed, F.col("field")))
    names = ("value", "confidence", "page", "heading", "method", "excerpt", "only_pointer", "truncated")
    rank = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    found = found.select(F.col(f"_doc.{record}").alias(record), "field", F.struct(F.col("_doc.position").alias("position"), *names).alias("b"), F.struct(rank, -F.col("_doc.position")).alias("rank"))
    best = found.groupBy(record, "field").agg(F.max_by("b", "rank").alias("b")).select(record, "field", "b.*")
    best = best.join(docs.select(record, "position", "url", "final_url"), [record, "position"])
    count = lambda c: F.count_if(c) > 0
    whole = docs.groupBy(record).agg(
        count("_ocr").alias("any_ocr"), (count("_in") & ~count(F.col("_quality") == "usable")).alias("no_text"), count("_in").alias("has_documents"),
        count(F.col("_in") & F.col("text").isNotNull()).alias("has_text"), *(_link(r).alias(f"_{r}") for r in roles),
    )
    fields = whole.withColumn("field", F.explode(F.array(*map(F.lit, every)))).join(best, [record, "field"], "left")
    first, *others = roles
    link = F.col(f"_{first}")
    for role in others:
        link = F.when(F.col("field").isin([f for f in roles[role] if f not in roles[first]]), F.col(f"_{role}")).otherwise(link)
    label = F.coalesce(F.nullif(link["label"], F.lit("")), *(F.when(link["role"] == r, x) for r, x in T.LABELS.items()), F.lit(T.ANY_DOCUMENT))
    choice = lambda a, b, c: F.when(F.col("no_text"), a).when(F.col("any_ocr"), b).otherwise(c)
    blank = lambda c: F.coalesce(c, F.lit(""))
    fallback = F.struct(
        choice("ocr_needed", "manual_review", "open_source_document").alias("mode"), label.alias("label"), blank(link["url"]).alias("url"), blank(link["final_url"]).alias("final_url"), choice(*T.WHY_MISSING).alias("reason")
    )
    missing = F.col("value").isNull()
    status = F.when(missing, choice("ocr_needed", "manual_review_recommended", "not_found")).when(F.col("only_pointer"), "evidence_only").when(F.col("confidence") == "high", "extracted").otherwise("partial")
    fields = fields.select(
        record, "field", status.alias("field_status"), "value", F.coalesce("confidence", F.lit("none")).alias("confidence"), "page", "heading", "method", F.left("excerpt", F.lit(excerpt)).alias("excerpt"),
        "position", "url", "final_url", F.coalesce("truncated", F.lit(False)).alias("truncated"), F.when(missing, fallback).alias("fallback"),
    )
    is_core = F.col("field").isin(list(core)) & F.col("field_status").isin("extracted", "partial")
    sums = fields.groupBy(record).agg(
        F.count("value").alias("fields_extracted"), (F.count("*") - F.count("value")).alias("fields_missing"), F.count_if(is_core).alias("core"), count(F.col("field_status") == "evidence_only").alias("pointer")
    )
    return fields, record_status(sums.join(whole.drop(*(f"_{r}" for r in roles)), record), record)


def record_status(sums: DataFrame, record: str) -> DataFrame:
    """Status, warnings and display options of records (fields_extracted, fields_missing, core, pointer, any_ocr, no_text, has_documents, has_text)."""
    none = F.col("fields_extracted") == 0
    status = (
        F.when(F.col("no_text") | ~F.col("has_documents"), F.when(F.col("has_text"), "ocr_needed").otherwise("failed")).when(none, "source_link_only").when((F.col("core") >= 4) & ~F.col("any_ocr"), "parsed").otherwise("partial")
    )
    rows = sums.withColumn("record_status", status)
    warnings = {"field_not_found": none, "manual_review_recommended": none, "ocr_needed": F.col("any_ocr"), "only_pointer_found": F.col("pointer"), "text_low_coverage": F.col("no_text")}
    message = F.lit(T.MESSAGES["partial"])
    for name in ("parsed", "ocr_needed", "source_link_only", "failed"):
        message = F.when(F.col("record_status") == name, T.MESSAGES[name]).otherwise(message)
    message = F.when((F.col("record_status") == "partial") & F.col("any_ocr"), T.MESSAGES["partial_ocr"]).otherwise(message)
    return rows.select(
        record, "record_status", "fields_extracted", "fields_missing", F.array_compact(F.array(*(F.when(c, n) for n, c in warnings.items()))).alias("warnings"),
        F.when(F.col("record_status") == "failed", "source_link_only").otherwise(F.col("record_status")).alias("badge"), (F.col("fields_extracted") > 0).alias("show_fields"),
        F.col("record_status").isin("partial", "source_link_only", "failed").alias("manual_review"), (F.col("any_ocr") | F.col("no_text")).alias("ocr_needed"), message.alias("message"),
    )
