"""Fields of notices, each on a text of its own, and the appendix of a record."""

import json

import pytest
from pyspark.sql import functions as F

from pliego.operators import appendix_tables as T
from pliego.operators import notice_fields as N

NOTICE = """Anuncio de licitación
Número de Expediente 2025 11
Publicado en la Plataforma de Contratación el 01-02-2025
Campaña de otoño
Contrato Sujeto a regulación armonizada Sí
Directiva 2014/24/UE
--- PAGE 2 ---
Objeto del Contrato: Diseño
de   imagen(cid:12)
Categorías/CPV
79340000 - Publicidad.
79341000 - Campañas.
79340000 - Otra vez.
texto
79999999 - Fuera.
Valor estimado del contrato 12.500,50 EUR.
Presupuesto base de licitación
Importe 1.210 EUR.
Importe (sin impuestos) 1.000 EUR.
Plazo de Ejecución
Del 01/02/2026 al 01/03/2026
Observaciones: con prórroga
Lugar de ejecución
Número de lotes: 2
Lote 1: Web: portal
x
Valor estimado del contrato 10 EUR
Lote 2: Papel
--- PAGE 3 ---
Plazo de Presentación de Oferta
Hasta el 15/01/2026 a las 14:00
Plazo de Presentación de Oferta
Hasta el 15/01/2026 a las 14:00
Plazo de validez de la oferta
3 Mes(es)
Criterios de adjudicación
Oferta económica
Subtipo Criterio : Precio
Ponderación : 60
Calidad del equipo
Subtipo Criterio : Otros
Cantidad mínima : 1
Ponderación : 40
Procedimiento Restringido
Tramitación Ordinaria
Presentación de la oferta Electrónica
Sistema de Contratación Acuerdo marco
Criterio de Solvencia Económica-Financiera
Cifra de negocio (ver apartado 7)
Criterio de Solvencia Técnica-Profesional
Tres trabajos
Preparación de oferta
No hay financiación con fondos de la UE
Sello de Tiempo"""


@pytest.fixture(scope="module")
def found(spark):
    texts = [(1, NOTICE), (2, "nada"), (3, None), (4, " \n\t\n"), (5, NOTICE.replace("Objeto del Contrato: Diseño", "x").replace("\n", "\r\n"))]
    return N.notice_fields(spark.createDataFrame(texts, "d int, t string"), ["d"], "t", F.lit(True)).cache()


@pytest.fixture(scope="module")
def by_field(found):
    return {(r["d"], r["field"]): r for r in found.collect()}


WANT = {
    "objeto": "Diseño de imagen", "cpv": [{"code": "79340000", "label": "Publicidad"}, {"code": "79341000", "label": "Campañas"}], "valor_estimado": {"amount": 12500.5, "currency": "EUR"},
    "presupuesto_base": {"importe_con_impuestos": 1210.0, "importe_sin_impuestos": 1000.0, "currency": "EUR"}, "duracion": {"desde": "2026-02-01", "hasta": "2026-03-01", "observaciones": "con prórroga"},
    "lotes": [{"num": 1, "descripcion": "Web: portal", "valor_estimado": 10.0}, {"num": 2, "descripcion": "Papel", "valor_estimado": None}],
    "plazos": [{"tipo": "presentacion_oferta", "fecha_limite": "2026-01-15", "hora": "14:00", "raw": None}, {"tipo": "validez_oferta", "fecha_limite": None, "hora": None, "raw": "3 Mes(es)"}],
    "criterios_adjudicacion": [{"nombre": "Oferta económica", "subtipo": "Precio", "ponderacion": 60}, {"nombre": "Calidad del equipo", "subtipo": "Otros", "ponderacion": 40}],
    "criterios_precio": {"ponderacion": 60}, "criterios_tecnicos": [{"nombre": "Calidad del equipo", "ponderacion": 40}],
    "contract_meta": {"num_expediente": "2025 11", "procedimiento": "Restringido", "tramitacion": "Ordinaria", "sistema_contratacion": "Acuerdo marco", "presentacion": "Electrónica", "directiva": "2014/24/UE"},
    "opportunity_flags": {"es_sda": False, "procedimiento_restringido": True, "sujeto_regulacion_armonizada": True, "fondos_ue": False, "num_lotes": 2, "deadline_valid": True},
}


@pytest.mark.parametrize("field", T.NOTICE)
def test_field_of_a_notice(by_field, field):
    value = by_field[1, field]["value"]
    assert (value if field == "objeto" else json.loads(value)) == WANT[field] and by_field[1, field]["evidence"]


def test_pages_and_confidence(by_field):
    shown = {f: (by_field[1, f]["confidence"], by_field[1, f]["field_status"], by_field[1, f]["page"]) for f in ("objeto", "presupuesto_base", "lotes", "plazos", "criterios_tecnicos", "contract_meta")}
    assert shown == {
        "objeto": ("high", "extracted", 2), "presupuesto_base": ("medium", "partial", 2), "lotes": ("medium", "partial", 2), "plazos": ("medium", "extracted", 1), "criterios_tecnicos": ("low", "partial", 3), "contract_meta": ("high", "extracted", 1),
    }


def test_solvency_is_never_a_value(by_field):
    eco, tec = by_field[1, "solvencia_economica"], by_field[1, "solvencia_tecnica"]
    assert (eco["value"], eco["field_status"], eco["evidence"]) == (None, "deferred_to_pcap", "Criterio de Solvencia Económica-Financiera Cifra de negocio (ver apartado 7)")
    assert (tec["value"], tec["field_status"], tec["evidence"]) == (None, "evidence_only", "Criterio de Solvencia Técnica-Profesional Tres trabajos")


@pytest.mark.parametrize("d", [2, 3, 4])
def test_texts_without_fields(by_field, d):
    rows = {f: r for (i, f), r in by_field.items() if i == d}
    assert len(rows) == 18 and [f for f, r in rows.items() if r["value"]] == ["opportunity_flags"]
    assert {r["field_status"] for r in rows.values()} == {"absent", "deferred", "extracted"}


def test_title_stands_for_a_missing_subject(by_field):
    r = by_field[5, "objeto"]
    assert (r["value"], r["confidence"], r["field_status"], r["page"]) == ("Campaña de otoño", "medium", "partial", 1)
    assert json.loads(by_field[5, "lotes"]["value"]) == WANT["lotes"]


def test_status_and_coverage(spark, found):
    assert {r["d"]: (r["coverage"], r["appendix_status"]) for r in N.appendix_status(found, ["d"]).collect()} == {
        1: (1.0, "partial"), 2: (0.083, "insufficient_text"), 3: (0.083, "insufficient_text"), 4: (0.083, "insufficient_text"), 5: (1.0, "partial")
    }
    complete = found.where(~F.col("field").isin(*T.DEFERRED, *T.EVIDENCE_ONLY))
    assert {r["d"] for r in N.appendix_status(complete, ["d"]).where("appendix_status = 'ready'").collect()} == {1, 5}


@pytest.mark.parametrize(
    ("text", "role"),
    [
        (NOTICE, "anuncio_placsp"), ("Documento de Pliegos\n" + NOTICE, "documento_pliegos"), ("Anuncio previo\nx", "anuncio_previo"), ("Índice\nPliego de cláusulas administrativas particulares", "pcap"),
        ("El pliego de prescripciones técnicas", "ppt"), ("Acta de adjudicación", "acta"), ("x", "unknown"), (None, "unknown"),
    ],
)
def test_roles(spark, text, role):
    df = spark.createDataFrame([(text,)], "t string").select(N.line_array(F.col("t")).alias("l"), N.fold_accents(F.coalesce("t", F.lit(""))).alias("f"))
    assert df.select(N.document_role(F.col("l"), F.col("f")).alias("r")).first()["r"]["role"] == role


def test_no_row_moves(found):
    assert "Exchange" not in N.notice_fields(found.sparkSession.createDataFrame([(1, "x")], "d int, t string"), ["d"], "t")._jdf.queryExecution().executedPlan().toString()


def test_brief_rows_say_which_fields_have_a_value(spark, found):
    texts = [(1, NOTICE), (2, "nada"), (3, None), (4, " \n\t\n"), (5, NOTICE.replace("Objeto del Contrato: Diseño", "x").replace("\n", "\r\n"))]
    brief = N.notice_fields(spark.createDataFrame(texts, "d int, t string"), ["d"], "t", F.lit(True), brief=True)
    assert {(r["d"], r["field"], r["value"], r["field_status"]) for r in brief.collect()} == {(r["d"], r["field"], True if r["value"] is not None else None, r["field_status"]) for r in found.collect()}
    assert sorted(map(tuple, N.appendix_status(brief, ["d"]).collect())) == sorted(map(tuple, N.appendix_status(found, ["d"]).collect()))


def test_matches_that_cross_lines(spark):
    texts = [(1, "Directiva\n \n2014/24/UE\nNúmero de lotes:\n\n3"), (2, "Directiva\n--- PAGE 2 ---\n2014/24/UE\nContrato sujeto a regulación armonizada\n\nSí")]
    rows = N.notice_fields(spark.createDataFrame(texts, "d int, t string"), ["d"], "t").where("value IS NOT NULL").collect()
    by = {(r["d"], r["field"]): json.loads(r["value"]) for r in rows}
    assert by[1, "contract_meta"]["directiva"] == "2014/24/UE" and by[1, "opportunity_flags"]["num_lotes"] == 3
    assert (2, "contract_meta") not in by and by[2, "opportunity_flags"]["sujeto_regulacion_armonizada"] is True


def test_status_query_reads_no_values(spark, sf_dir):
    from pliego.plans.appendix import appendix_status

    plan = appendix_status(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "StructsToJson" not in plan and "_folded" in plan
