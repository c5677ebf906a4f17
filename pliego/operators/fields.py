"""Fields read from the lines of notice texts: value, confidence and evidence for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import spanish_number
from .lines import windows_after

# Headings of a notice, without accents and in lower case.
HEADINGS = ("descripcion del procedimiento", "valor estimado del contrato", "presupuesto base de licitacion", "categorias/cpv", "clasificacion cpv", "plazo de ejecucion", "lugar de ejecucion")
DEADLINES = {
    "plazo de presentacion de oferta": "presentacion_oferta", "plazo de recepcion de solicitudes de": "recepcion_solicitudes_participacion",
    "plazo de obtencion de pliegos": "obtencion_pliegos", "periodo de vigencia del sistema dinamico": "vigencia_sistema_dinamico", "plazo de presentacion": "presentacion_recursos",
}
FIELDS = 12


def is_heading(fold: Column) -> Column:
    return fold.rlike("^(" + "|".join(HEADINGS) + ")")


def _found(rows: DataFrame, ident: str, name: str, value: Column, confidence: str, evidence: Column) -> DataFrame:
    """The first line of each text that gives a value."""
    kept = rows.withColumns({"_v": value, "_e": evidence}).where("_v is not null and _v <> ''")
    one = kept.groupBy(ident).agg(F.min_by(F.struct(F.col("_v").alias("value"), "page", F.left("_e", F.lit(300)).alias("evidence")), "line_no").alias("f"))
    return one.select(ident, F.lit(name).alias("field"), "f.value", F.lit(confidence).alias("confidence"), "f.page", "f.evidence")


def subject(rows: DataFrame, ident: str) -> DataFrame:
    """The subject after its heading, with the lines up to the next heading."""
    found = windows_after(rows, ident, F.col("fold").startswith("objeto del contrato:"), 4, is_heading(F.col("fold")))
    value = F.trim(F.regexp_replace(F.concat_ws(" ", F.regexp_extract("raw", r"^[^:]*:(.*)$", 1), "window"), r"\s+", " "))
    return _found(found, ident, "objeto", value, "high", F.concat(F.lit("Objeto del Contrato: "), value))


def codes(rows: DataFrame, ident: str) -> DataFrame:
    """Classification codes in the lines after their heading."""
    found = windows_after(rows, ident, F.col("fold").rlike("^(categorias/cpv|clasificacion cpv)"), 11, F.col("raw").rlike(r"^\s*[^\d\s]"))
    value = F.array_join(F.array_distinct(F.regexp_extract_all("window", F.lit(r"\b(\d{8})\s*-"), 1)), ",")
    return _found(found, ident, "cpv", value, "high", F.col("window"))


def estimated_value(rows: DataFrame, ident: str) -> DataFrame:
    amount = spanish_number(F.nullif(F.regexp_extract("fold", r"valor estimado del contrato\s+([\d.,]+)\s*eur", 1), F.lit("")))
    return _found(rows, ident, "valor_estimado", amount.cast("string"), "high", F.col("raw"))


def base_budget(rows: DataFrame, ident: str) -> DataFrame:
    """The amounts with and without taxes after the heading of the base budget."""
    found = windows_after(rows.withColumn("raw", F.col("fold")), ident, F.col("fold").startswith("presupuesto base de licitacion"), 4, is_heading(F.col("fold")))
    net = spanish_number(F.nullif(F.regexp_extract("window", r"importe\s*\(sin impuestos\)\s+([\d.,]+)\s*eur", 1), F.lit("")))
    gross = spanish_number(F.nullif(F.regexp_extract("window", r"importe\s+([\d.,]+)\s*eur", 1), F.lit("")))
    value = F.when(net.isNotNull() | gross.isNotNull(), F.concat_ws("|", F.coalesce(gross.cast("string"), F.lit("")), F.coalesce(net.cast("string"), F.lit(""))))
    return _found(found, ident, "presupuesto_base", value, "medium", F.col("window"))


def duration(rows: DataFrame, ident: str) -> DataFrame:
    found = windows_after(rows, ident, F.col("fold").contains("plazo de ejecucion"), 3)
    days = F.regexp_extract(F.lower(F.concat_ws(" ", "raw", "window")), r"(del\s+\d{2}/\d{2}/\d{4}\s+al\s+\d{2}/\d{2}/\d{4})", 1)
    value = F.regexp_replace(days, r"del\s+(\d{2})/(\d{2})/(\d{4})\s+al\s+(\d{2})/(\d{2})/(\d{4})", "$3-$2-$1|$6-$5-$4")
    return _found(found, ident, "duracion", value, "high", F.col("window"))


def deadlines(rows: DataFrame, ident: str) -> DataFrame:
    """(ident, kind, date, hour): each deadline after its heading, once."""
    kind = None
    for prefix, name in DEADLINES.items():
        hit = F.col("fold").startswith(prefix)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    tagged = rows.withColumn("kind", kind)
    found = windows_after(tagged, ident, F.col("kind").isNotNull(), 3)
    text = F.lower(F.concat_ws(" ", "raw", "window"))
    pattern = r"hasta el\s+(\d{2})/(\d{2})/(\d{4})\s+a las\s+(\d{2}:\d{2})"
    date = F.concat_ws("-", *(F.regexp_extract(text, pattern, g) for g in (3, 2, 1)))
    return found.select(ident, "kind", date.alias("date"), F.regexp_extract(text, pattern, 4).alias("hour")).where("hour <> ''").distinct()


def all_fields(rows: DataFrame, ident: str) -> DataFrame:
    """(ident, field, value, confidence, page, evidence) of all single fields."""
    out = None
    for f in (subject, codes, estimated_value, base_budget, duration):
        out = f(rows, ident) if out is None else out.unionByName(f(rows, ident))
    return out


def best_of_documents(found: DataFrame, record: str, position: str) -> DataFrame:
    """For each record and field the most confident value, that of the first document on a tie."""
    rank = F.when(F.col("confidence") == "high", 2).when(F.col("confidence") == "medium", 1).otherwise(0)
    best = F.max_by(F.struct("value", "confidence", position), F.struct(rank, -F.col(position)))
    return found.groupBy(record, "field").agg(best.alias("b")).select(record, "field", "b.*")


def coverage(found: DataFrame, ident: str, total: int = FIELDS) -> DataFrame:
    """(ident, coverage, status): the share of fields that were found."""
    out = found.groupBy(ident).agg(F.round(F.count_distinct("field") / total, 3).alias("coverage"))
    return out.withColumn("status", F.when(F.col("coverage") >= 0.5, "ready").when(F.col("coverage") >= 0.25, "partial").otherwise("insufficient"))


def references(rows: DataFrame, ident: str) -> DataFrame:
    """Lines between the classification heading and the bidding process that name an attached file."""
    w = Window.partitionBy(ident)
    lo = F.min(F.when(F.col("fold").rlike("^(categorias/cpv|clasificacion cpv)"), F.col("line_no"))).over(w)
    hi = F.min(F.when(F.col("fold").startswith("proceso de licitacion"), F.col("line_no"))).over(w)
    inside = rows.withColumns({"_lo": lo, "_hi": hi}).where((F.col("line_no") > F.col("_lo")) & (F.col("line_no") < F.coalesce("_hi", F.col("line_no") + 1)))
    label = F.trim(F.regexp_replace(F.regexp_replace("raw", r"^(\s*\d+[.)]?\s*){0,4}", ""), r"\s+", " "))
    return inside.where(F.lower("raw").rlike(r"\.(pdf|docx?|xlsx?|zip)\b")).select(ident, "page", "line_no", label.alias("label"))
