"""Records, fields of notice texts and the public contract."""

import pytest
from pyspark.sql import functions as F

from pliego.functions import contract as C
from pliego.operators import fields as X
from pliego.operators import lines as L
from pliego.operators import records as R


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_clean_up(spark):
    assert [one(spark, R.clean_source(F.lit(s))) for s in ("LOCAL", "LOCAL-ZIP", "LOCALE")] == ["PLACSP", "PLACSP", "LOCALE"]
    assert [one(spark, R.clean_awardee(F.lit(s))) for s in ("<b>A</b>  S.L.", "Ver detalle")] == ["A S.L.", ""]
    assert [one(spark, R.valid_https(F.lit(s))) for s in ("https://a.es/x", "http://a.es", "https://", "x", None)] == [True, False, False, False, False]
    assert one(spark, R.folded_contains(F.lit("José Ñúñez"), "jose")) and [one(spark, R.first_letter(F.lit(s))) for s in ("ávila", "3M", "")] == ["A", "#", "#"]


def test_spanish_order(spark):
    names = spark.createDataFrame([("zeta",), ("ñandú",), ("nube",), ("Ábaco",), (None,), ("abeja",)], "n string")
    assert [r["n"] for r in names.orderBy(*R.ui_order(F.col("n").isNull(), "n", True)).collect()] == ["Ábaco", "abeja", "nube", "ñandú", "zeta", None]


def test_document_lists(spark):
    rows = [(1, 0, "u:a", "x"), (1, 1, "u:a", "resolver"), (1, 2, None, "y"), (1, 3, None, "y"), (1, 4, "u:b", "z")]
    got = R.distinct_documents(spark.createDataFrame(rows, "r int, pos int, ident string, by string"), "r", "ident", "pos", F.col("by") == "resolver")
    assert sorted((x["pos"], x["by"]) for x in got.collect()) == [(0, "resolver"), (2, "y"), (3, "y"), (4, "z")]
    assert one(spark, R.document_identity(F.lit("HTTPS://A.es/P"), F.lit(None).cast("string"), [F.lit("n")])) == "u:https://a.es/P"
    assert one(spark, R.document_identity(F.lit("junk"), F.lit(""), [F.lit(""), F.lit(None).cast("string")])) is None
    roles = {("LegalDocumentReference", "", ""): "pcap", ("", "ACTA_FORM", ""): "formalization_minutes", ("additionalPublicationDocumentReference", "", "award"): "notice_award", ("", "", ""): "document"}
    assert all(one(spark, R.document_role(*map(F.lit, k))) == v for k, v in roles.items())


def test_persistence_cascade(spark):
    ok = ("r1", "k1", "http://d/1", "application/pdf", True, True, [])
    rows = [
        (0, "c0", *ok), (1, "c0", *ok), (2, "c2", *ok), (3, None, *ok), (4, "c4", "r1", "", *ok[2:]), (5, "c5", "r1", "k1", "http://d/5", "text/html; charset", True, True, []),
        (6, "c6", "r9", "k1", "http://d/6", "application/pdf", True, True, []), (7, "c7", "r1", "k1", "http://old", "application/pdf", True, True, []), (8, "c8", "r1", "k1", "http://d/8", "application/pdf", True, True, ["x"]),
    ]
    candidates = spark.createDataFrame(rows, "pos int, candidate_id string, record_id string, canonical_key string, final_url string, content_type string, is_document boolean, ready boolean, blockers array<string>")
    records = spark.createDataFrame([("r1", "k1", True, 0)], "record_id string, canonical_key string, enriched boolean, pos int")
    existing = spark.createDataFrame([("r1", "http://old")], "record_id string, url string")
    got = {r["pos"]: r["reason"] for r in R.persistence(candidates, records, existing).collect()}
    assert got == {0: None, 1: "duplicate_candidate_id", 2: "duplicate_final_url", 3: "missing_candidate_id", 4: "missing_canonical_key", 5: "html_page", 6: "record_not_found", 7: "existing_document_url", 8: "merge_blockers_present"}


def test_legacy_merge(spark):
    schema = "id string, estat string, adjudicatari string, data_pub string, historial array<struct<data:string,estat:string,nota:string>>, url string"
    previous = spark.createDataFrame([("a", "Vigente", "", "d0", [], "u"), ("b", "Vigente", "", "d0", [], "v")], schema)
    incoming = spark.createDataFrame([("a", "Adjudicado", "W", "d1", [], ""), ("c", "Vigente", "", "d2", [], "w")], schema)
    got = {r["id"]: r for r in R.legacy_merge(previous, incoming, "t", ["url"]).collect()}
    assert (got["a"]["url"], [h["nota"] for h in got["a"]["historial"]]) == ("u", ["Adjudicado a W"])
    assert [(got[k]["outcome"], [h["nota"] for h in got[k]["historial"]]) for k in "bc"] == [("preserved", []), ("new", ["Publicación"])]


TEXT = """--- PAGE 1 ---
Objeto del Contrato: Campaña
de imagen
Categorías/CPV
79340000 - Publicidad.
79341000 - Otros.
1. Anexo técnico.pdf
Proceso de Licitación
--- PAGE 2 ---
Valor estimado del contrato 12.500,50 EUR.
Presupuesto base de licitación
Importe 1.210 EUR.
Importe (sin impuestos) 1.000 EUR.
Plazo de Ejecución
Del 01/02/2026 al 01/03/2026
Plazo de Presentación de Oferta
Hasta el 15/01/2026 a las 14:00"""


def test_fields_of_a_notice(spark):
    rows = L.with_pages(L.lines(spark.createDataFrame([(1, TEXT), (2, "nada")], "d int, t string"), "d", "t"), "d")
    got = {r["field"]: (r["value"], r["page"]) for r in X.all_fields(rows, "d").collect()}
    assert got == {"objeto": ("Campaña de imagen", 1), "cpv": ("79340000,79341000", 1), "valor_estimado": ("12500.5", 2), "presupuesto_base": ("1210.0|1000.0", 2), "duracion": ("2026-02-01|2026-03-01", 2)}
    assert [tuple(r) for r in X.deadlines(rows, "d").collect()] == [(1, "presentacion_oferta", "2026-01-15", "14:00")]
    assert [r["label"] for r in X.references(rows, "d").collect()] == ["Anexo técnico.pdf"]
    assert X.coverage(X.all_fields(rows, "d"), "d").first()["coverage"] == round(5 / 12, 3)


@pytest.mark.parametrize(("host", "want"), [("localhost", True), ("10.1.2.3", True), ("172.20.0.1", True), ("172.40.0.1", False), ("2130706433", True), ("0x7f.1", True), ("[::1]", True), ("example.com", False), ("8.8.8.8", False), ("a.internal", True)])
def test_private_hosts(spark, host, want):
    assert one(spark, C.private_host(F.lit(host))) is want


def test_contract_texts(spark):
    assert one(spark, C.to_zulu(F.lit("2026-01-01T10:00:00+02:00"))) == "2026-01-01T08:00:00Z" and one(spark, C.to_zulu(F.lit("x"))) is None
    assert one(spark, C.in_order(F.lit("2026-01-01T00:00:00Z"), F.lit("2026-01-01T00:00:01Z"))) and not one(spark, C.in_order(F.lit("2026-01-02T00:00:00Z"), F.lit("2026-01-01T00:00:01Z")))
    assert one(spark, C.generation_matches(F.lit("gen-20260101T000000Z-0123456789ab"), F.lit("2026-01-01T00:00:00Z"), F.lit("0123456789abcdef")))
    assert one(spark, C.public_url(F.lit("https://a.es/x"))) and not one(spark, C.public_url(F.lit("https://u:p@a.es"))) and not one(spark, C.public_url(F.lit("ftp://a.es")))
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "i int, s string"), spark.createDataFrame([(2, "y"), (1, "x")], "i int, s string")
    assert C.digest(a).first() == C.digest(b).first() != C.digest(a.limit(1)).first()
