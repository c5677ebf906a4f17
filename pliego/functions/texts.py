"""Small text rules: markup, snippets, labels, roles of documents."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .semantics import fold_accents

#: The names of character references as the standard library lists them; some count without their semicolon too.
ENTITIES = {n: v for n, v in html5.items() if n.endswith(";")}
OPEN_ENTITIES = {n: v for n, v in html5.items() if not n.endswith(";")}


def unescaped(c: Column) -> Column:
    """Character references as the characters they stand for: numbers, and all names of HTML, the old ones also where a text goes on without a semicolon.

    Each is replaced once: longer ones first, those that stand for an ampersand last.
    """
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"(&(?:#[xX]?[0-9a-fA-F]{1,6};|[A-Za-z][A-Za-z0-9]{1,31};?))"), 1))
    number = lambda r: F.when(F.lower(r).startswith("&#x"), F.conv(F.regexp_extract(r, "([0-9a-fA-F]+);", 1), 16, 10).cast("int")).otherwise(F.regexp_extract(r, "([0-9]+);", 1).try_cast("int"))
    sign = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")
    names = F.create_map(*(F.lit(x) for n, v in ENTITIES.items() for x in (f"&{n}", v)))
    opened = F.array(*(F.struct(F.lit(-len(n)).alias("size"), F.lit(f"&{n}").alias("name"), F.lit(v).alias("v")) for n, v in OPEN_ENTITIES.items()))
    start = lambda r: F.array_min(F.filter(opened, lambda x: F.startswith(r, x["name"])))  # noqa: E731  the longest
    begun = lambda r: F.concat(start(r)["v"], F.substr(r, F.length(start(r)["name"]) + 1))
    meant = F.transform(found, lambda r: F.struct(-F.length(r).alias("size"), r.alias("r"), F.coalesce(names[r], sign(number(r)), begun(r), r).alias("v")))
    last = lambda x: F.startswith(x["v"], F.lit("&"))
    ordered = F.array_sort(meant)
    return F.aggregate(F.concat(F.filter(ordered, lambda x: ~last(x)), F.filter(ordered, last)), c, lambda text, x: F.replace(text, x["r"], x["v"]))


def strip_html(c: Column) -> Column:
    """Character references resolved, tags as spaces, white space collapsed; null gives ''."""
    text = F.when(F.contains(c, F.lit("&")), unescaped(c)).otherwise(F.coalesce(c, F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"(?U)\s+", " "))


def snippet(content: Column, limit: int = 160) -> Column:
    """The start of a binary column as one printable line of at most ``limit`` signs."""
    text = F.decode(F.substring(content, 1, 600), "UTF-8")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"[\x00-\x1f\x7f]", ""))
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.left(text, F.lit(limit - 1))), F.lit("…"))).otherwise(text)


def clean_line(c: Column) -> Column:
    """A line of extracted text without glyph numbers, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\(cid:\d+\)", ""), r"(?U)\s+", " "))


def title_key(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")))


def split_codes(c: Column) -> Column:
    """The codes of a comma-separated text, trimmed, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def cap_first(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.substring(c, 2, 2147483647))


def escape_html(c: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def label(c: Column) -> Column:
    """A document's label without leading section numbers and the space before its extension."""
    text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"^(?:\d+[.)]?\s+){1,4}", "")), r"\s+(\.[A-Za-z0-9]+)$", "$1")


def role_of_label(c: Column) -> Column:
    """The role that a document's label names; the first rule that fits counts."""
    f = fold_accents(c)
    has = f.contains
    return (
        F.when(has("prescripciones") & has("tecn") | has("pliego") & has("tecnic"), "ppt").when(has("clausulas administrativ") | has("pliego") & has("administrativ"), "pcap")
        .when(has("declaracion"), "declaracion").when(has("modelo"), "modelo").when(has("oferta"), "oferta").when(has("anexo") | has("annex"), "anexo").otherwise("other")
    )


def role_of_text(text: Column) -> Column:
    """struct(role, confidence) of a document by its content: the first three lines, then phrases anywhere."""
    f = fold_accents(F.coalesce(text, F.lit("")))
    header, has = F.array_join(F.slice(F.split(f, "\n"), 1, 3), " "), f.contains
    role = (
        F.when(header.contains("documento de pliegos"), "documento_pliegos").when(header.startswith("anuncio previo"), "anuncio_previo")
        .when(has("anuncio de licitacion") & has("numero de expediente") & (has("plataforma de contratacion") | has("sello de tiempo")), "anuncio_placsp")
        .when(has("pliego de clausulas administrativas particulares"), "pcap").when(has("pliego de prescripciones tecnicas"), "ppt")
        .when(has("acta de adjudicacion") | has("acta de formalizacion") | has("formalizacion del contrato"), "acta").otherwise("unknown")
    )
    return F.struct(role.alias("role"), F.when(role == "unknown", "low").when(role == "acta", "medium").otherwise("high").alias("confidence"))


def endpoint_family(url: Column) -> Column:
    return F.when(url.contains("GetDocumentByIdServlet"), "servlet_direct").when(url.contains("docAccCmpnt") | url.contains("GetDocumentsById"), "docAccCmpnt_wrapper").otherwise("other")
