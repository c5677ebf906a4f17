"""Signals of a selection and of a period against the one before: for, against and with caution, each with its numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.semantics import number_es as _count
from ..functions.semantics import pct, pct_label

_ITEM = "array<struct<label:string,reason:string>>"


def _text(*parts: Column | str | int) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _listed(*items: tuple[Column, str, Column]) -> Column:
    """The (label, reason) of the items whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(label).alias("label"), reason.alias("reason"))) for c, label, reason in items))).cast(_ITEM)


# The labels of signals and the texts of their reasons.


def structural(m: Column) -> Column:
    """struct(positive, negative, caution), lists of (label, reason), of a selection's coverage.

    m has total, with_date, with_org, disciplines, with_budget, unclassified, with_documents,
    with_territory, national, with_awardee. Shares are whole percentages; nothing is said of an
    empty selection but the caution that always holds.
    """
    n = m["total"]
    p = lambda c: pct(c, n)
    some = n > 0
    share = lambda c: _text(" (", pct_label(c, n), ")")
    of_all = lambda c, end: _text(_count(c), " de ", _count(n), " registros", share(c), end)
    no_place, no_budget = n - m["with_territory"], n - m["with_budget"]
    positive = _listed(
        (some & (p(m["with_date"]) >= 90), "Alta cobertura de fecha de publicación", of_all(m["with_date"], " informan fecha.")),
        (some & (p(m["with_org"]) >= 90), "Alta cobertura de organismo", of_all(m["with_org"], " informan organismo.")),
        (m["disciplines"] >= 6, "Amplitud de disciplinas", _text(m["disciplines"].cast("string"), " disciplinas presentes en la selección.")),
        (some & (p(m["with_budget"]) >= 50), "Presupuesto base informado con frecuencia", of_all(m["with_budget"], " con presupuesto base.")),
    )
    negative = _listed(
        (some & (p(m["unclassified"]) >= 25), "Alta proporción sin disciplina", _text(_count(m["unclassified"]), " registros", share(m["unclassified"]), " aún sin clasificar · calidad de datos.")),
        (some & (p(m["with_documents"]) < 50), "Cobertura documental baja", _text("Solo ", of_all(m["with_documents"], " tienen documentos enlazados."))),
        (some & (p(no_place) >= 20), "Registros sin territorio", _text(_count(no_place), " registros", share(no_place), " no informan territorio.")),
        (some & (p(no_budget) >= 50), "Mayoría sin presupuesto informado", of_all(no_budget, " sin presupuesto base.")),
    )
    caution = _listed(
        (m["national"] > 0, "Concentración estatal (ES)", _text("El ámbito estatal supone el ", pct_label(m["national"], n), " de la selección y no equivale a un territorio local.")),
        (F.lit(True), "Cobertura 2024–actual", F.lit("El dataset no es un censo completo del mercado.")),
        (m["with_budget"] > 0, "Presupuesto base orientativo", F.lit("No es el importe de adjudicación ni equivale al valor de mercado.")),
        (m["with_documents"] > 0, "Documentos enlazados", F.lit("Enlazados desde el expediente, no leídos ni analizados.")),
        (m["with_awardee"] > 0, "Adjudicataria informada", F.lit("Campo informado en el expediente; no acredita la adjudicación real ni sus importes.")),
    )
    return F.struct(positive.alias("positive"), negative.alias("negative"), caution.alias("caution"))


def periodic(now: Column, before: Column, has_before: Column, future: Column, running: Column, before_title: Column) -> Column:
    """struct(positive, negative, caution) of a period against the one before.

    Both have total, with_budget, with_documents, disciplines, unclassified, void, national. They
    are compared only if there is a period before, this one is not in the future and has no
    fewer than ten records, unless it has none.
    """
    low = (now["total"] > 0) & (now["total"] < 10)
    known, ahead = F.coalesce(has_before, F.lit(False)), F.coalesce(future, F.lit(False))
    compare = known & ~ahead & ~low
    text = lambda c: c.cast("string")
    share = lambda m, c: pct(m[c], m["total"])
    change, versus = now["total"] - before["total"], lambda a, b, unit="": _text(text(a), unit, " vs ", text(b), unit)
    more = lambda c: compare & (now[c] > before[c])
    less = lambda c: compare & (now[c] < before[c])
    docs, gone, blank = (share(now, "with_documents"), share(before, "with_documents")), (share(now, "void"), share(before, "void")), (share(now, "unclassified"), share(before, "unclassified"))
    against = _text(" vs ", before_title, " (", text(before["total"]), ")")
    positive = _listed(
        (compare & (change > 0), "Más actividad que el periodo anterior", _text("+", text(change), against)), (more("with_budget"), "Más registros con presupuesto", versus(now["with_budget"], before["with_budget"])),
        (compare & (docs[0] > docs[1]), "Mayor cobertura documental", versus(*docs, "%")), (more("disciplines"), "Más disciplinas presentes", versus(now["disciplines"], before["disciplines"])),
    )
    negative = _listed(
        (compare & (change < 0), "Menos actividad que el periodo anterior", _text(text(change), against)), (less("with_budget"), "Menos registros con presupuesto", versus(now["with_budget"], before["with_budget"])),
        (compare & (docs[0] < docs[1]), "Menor cobertura documental", versus(*docs, "%")), (less("disciplines"), "Menos disciplinas presentes", versus(now["disciplines"], before["disciplines"])),
        (compare & (now["unclassified"] > 0) & (blank[0] > blank[1]), "Más registros sin disciplina", _text(versus(*blank, "%"), " · calidad de datos")),
        (compare & (now["void"] >= 3) & (gone[0] > gone[1]), "Mayor proporción de desiertas", versus(*gone, "%")),
    )
    caution = _listed(
        (low, "Periodo de bajo volumen", _text("Solo ", text(now["total"]), " registros: evita conclusiones fuertes.")),
        (running, "Periodo en curso", F.lit("Cifras parciales; la comparación con periodos cerrados es orientativa.")),
        (~known & ~ahead, "Sin periodo anterior comparable", F.lit("No hay cuatrimestre previo en la cobertura para comparar.")),
        (now["national"] > 0, "Concentración estatal (ES)", _text("El ámbito estatal supone el ", text(share(now, "national")), "% y puede distorsionar la lectura territorial.")),
        (F.lit(True), "Cobertura 2024–actual", F.lit("El dataset no es un censo completo del mercado.")),
        (now["with_budget"] > 0, "Presupuesto orientativo", F.lit("El presupuesto base no equivale al valor de mercado.")),
        (F.lit(True), "Documentos enlazados", F.lit("Los documentos están enlazados, no leídos ni analizados.")),
    )
    return F.struct(positive.alias("positive"), negative.alias("negative"), caution.alias("caution"))
