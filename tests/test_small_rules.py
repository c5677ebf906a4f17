"""Rules that stand beside larger ones: skipped links, bridges, cleaned items, identities, findings, samples, filters, numbers."""

import random

import pytest
from pyspark.sql import functions as F

from pliego.functions import semantics as S
from pliego.operators import aggregates as A
from pliego.operators import dedup as D
from pliego.operators import evidence as E
from pliego.operators import privacy as P
from pliego.operators import records as R
from pliego.operators import views as V


def test_skipped_candidates(spark):
    rows = [
        (1, "r", "Pliego PDF", "high", "pdf", "f"), (2, "r", "Pliego HTML", "high", "", "f"), (3, "r", "Anexo xml", "high", "gateway", "g"), (4, "r", " Ver ", "high", "", "f"), (5, "r", "x Deferred  Modules", "high", "", None), (6, "r", "XML", "high", "", None),
        (7, "r", "Descargar todos  los archivos", "high", "", None), (8, "r", "Pliego html", "low", "", "f"), (9, "s", "Pliego HTML", "high", "", "f"), (10, "r", "Pliego html", "high", "", None),
    ]
    got = {r["i"]: r["skipped"] for r in E.with_skips(spark.createDataFrame(rows, "i int, r string, text string, confidence string, extension string, family string"), "r", 1).collect()}
    assert got == {1: None, 2: "pdf_preferred", 3: None, 4: "ver_title", 5: "deferred_modules", 6: "generic_html_xml", 7: "generic_nav", 8: "below_min_confidence", 9: None, 10: None}


def test_bridged_persistence_has_all_reasons(spark):
    c = lambda pos, ident, url="u", kind="application/pdf", doc=True, ready=True, blockers=(), key="k": (pos, ident, key, url, kind, doc, ready, list(blockers))
    rows = [
        c(1, ""), c(2, "a"), c(3, "a"), c(4, "b", key=""), c(5, "c", url=None), c(6, "d", kind="text/html; x"), c(7, "e", doc=False), c(8, "f", ready=False), c(9, "g", blockers=["x"]), c(10, "h"), c(11, "i"), c(12, "j"), c(13, "l"), c(14, "m", url="have"),
        c(15, "n"), c(16, "o"), c(17, "p", url="v"), c(18, "q", url="v"),
    ]
    candidates = spark.createDataFrame(rows, "pos int, candidate_id string, canonical_key string, final_url string, content_type string, is_document boolean, ready boolean, blockers array<string>").withColumn("record_id", F.lit("own"))
    bridge = [(1, "a", "one", "k"), (2, "i", "", "k"), (3, "j", "lost", "k"), (4, "l", "many", "k"), (5, "m", "one", "k"), (6, "n", "x", "k"), (7, "n", "one", "k"), (8, "o", "one", "z"), (9, "p", "copies", "zz"), (10, "q", "copies", "zz")]
    records = [(1, "one", "k", False), (2, "many", "a", True), (3, "many", "b", True), (4, "copies", "a", True), (5, "copies", "b", False)]
    own = R.existing_urls(spark.createDataFrame([("one", [("have",), (None,)]), ("one", [("have",)]), (None, [("x",)]), ("two", None)], "record_id string, documents array<struct<url:string>>"))
    assert [tuple(r) for r in own.collect()] == [("one", "have")]
    found = R.bridged_persistence(candidates, spark.createDataFrame(bridge, "pos int, candidate_id string, record_id string, canonical_key string"), spark.createDataFrame(records, "pos int, record_id string, canonical_key string, enriched boolean"), own)
    assert {r["pos"]: r["reason"] for r in found.collect()} == {
        1: "missing_candidate_id", 2: None, 3: "duplicate_candidate_id", 4: "missing_canonical_key", 5: "missing_final_url", 6: "html_page", 7: "not_document", 8: "not_merge_ready", 9: "merge_blockers_present", 10: "candidate_not_found",
        11: "record_id_missing", 12: "record_not_found", 13: "ambiguous_record", 14: "existing_document_url", 15: "duplicate_final_url", 16: "duplicate_final_url", 17: None, 18: "duplicate_evidence_final_url",
    }


def test_cleaned_items(spark):
    rows = [("LOCAL", "Dise&#241;o  <b>Uno</b>\n&amp; Co"), ("LOCAL-ZIP", "Ver detalle"), ("PLACSP", ""), (None, None), ("LOCALX", "&#60;x&#62;y")]
    got = [tuple(r) for r in R.cleaned_item(spark.createDataFrame(rows, "font string, adjudicatari string")).collect()]
    assert got == [("PLACSP", "Diseño Uno &amp; Co"), ("PLACSP", ""), ("PLACSP", ""), (None, None), ("LOCALX", "y")]


def test_identities_of_scripts(spark):
    texts = ['{"id":1}', '{"id":1.0}', '{"id":"1"}', '{"id":true}', '{"id":0,"url":"1"}', '{"id":"","url":"u"}', '{"id":null}', '{"id":false,"url":0}', '{"id":"__idx__6"}', '{"id":[1]}', '{"id":0,"url":{"a":1}}', "[1]", "7", "no json", '{"id":2.5}', '{"id":25e-1}', "{}"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    # 1 and 1.0; "1" twice; true; "u"; places 6 (with its namesake), 7 and 16; 2.5 twice
    assert tuple(A.script_identities(df, "t", "i").first()) == (8, 5)
    assert tuple(A.script_identities(df.limit(0), "t", "i").first()) == (0, 0)


def test_findings_once_each(spark):
    rows = [("s", "public-build", "ERROR", "A", "/x", "string", 3)] * 2 + [("s", "public-build", "WARN", "B", "/x", "string", 3), ("r", "public-build", "ERROR", "A", "/y", None, None)]
    df = spark.createDataFrame(rows, "source string, surface string, severity string, rule string, pointer string, kind string, length int")
    assert [(r["source"], r["rule"], r["n"]) for r in P.collapsed(df).orderBy(*P.report_order()).collect()] == [("r", "A", 1), ("s", "A", 2), ("s", "B", 1)]
    assert sorted(tuple(r) for r in P.grouped_summary(df).collect()) == [("ERROR", "A", "r", 1), ("ERROR", "A", "s", 2), ("WARN", "B", "s", 1)]


@pytest.mark.parametrize("seed", range(6))
def test_spread_samples(spark, seed):
    r = random.Random(seed)
    strata = ["parsed", "partial", "ocr_needed"]
    rows = [(i, r.choice([*strata, "other", None])) for i in range(r.choice([0, 3, 20]))]
    want = [next((x for x in rows if x[1] == s), None) for s in strata]
    want = [x for x in want if x]
    want = (want + [x for x in rows if x not in want])[:5]
    got = [tuple(x) for x in D.spread(spark.createDataFrame(rows, "i int, s string").repartition(3), "s", strata, "i").collect()]
    assert got == want


def test_statistics_filter_and_order(spark):
    rows = [(1, "2025-01-02", "CT", "Vigente", ["web"], 5, 1.0), (2, "2025-09-02", "CT", "Adjudicado", None, 5, None), (3, "2024-09-30", "MD", "Vigente", ["branding"], None, 9.0), (4, None, None, None, [], 5, 2.0), (5, "2025-09-02", "CT", "Vigente", ["web"], 7, 0.5), (6, "2025", "CT", "Vigente", [], 5, 1.0)]
    df = spark.createDataFrame(rows, "i int, data_pub string, ccaa string, estat string, disciplines array<string>, rellevancia int, pressupost double")
    ids = lambda **f: [r["i"] for r in V.statistics_rows(df, **f).orderBy("i").collect()]
    assert ids() == [1, 2, 3, 4, 5, 6] and ids(year="2025") == [1, 2, 5, 6] and ids(period=3) == [2, 3, 5] and ids(year="2025", period=3, ccaa="CT", status="Vigente", disciplines=["web", "x"]) == [5]
    assert [r["i"] for r in df.orderBy(*R.master_order("i")).collect()] == [5, 2, 1, 6, 3, 4]


def test_numbers_as_they_are_written(spark):
    values = [0.0, 999.4, 1234.0, 9999.6, 12345.0, 1234567.5, -12345.0, None]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(S.number_es(F.col("v")).alias("n"), S.money_full(F.col("v")).alias("m")).collect()
    assert [r["n"] for r in got] == ["0", "999", "1234", "10.000", "12.345", "1.234.568", "-12.345", "0"]
    assert got[4]["m"] == "12.345 €" and got[7]["m"] == "—"


@pytest.mark.parametrize("cells", [256, 1, 0.01])
def test_medians_of_large_groups(spark, cells):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.choice([None, float(r.randint(-5, 5)), r.random() * 10 ** r.randint(-3, 9), 0.0, 7.0])) for _ in range(700)] + [("one", 3.0), ("two", 1.0), ("two", 9.0), ("none", None)]
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, []).append(v)
    got = {x["k"]: x["median"] for x in A.medians(spark.createDataFrame(rows, "k string, v double"), ["k"], F.col("v"), cells).collect()}
    assert got == {k: sorted(v)[len(v) // 2] for k, v in want.items()}
    every = sorted(v for v in (x[1] for x in rows) if v is not None)
    assert [x["median"] for x in A.medians(spark.createDataFrame(rows, "k string, v double"), [], F.col("v"), cells).collect()] == [every[len(every) // 2]]


def test_candidates_to_resolve(spark):
    rows = [(1, "a", True, "pdf", "X.es"), (2, "b", None, "gateway", "x.es"), (3, "c", None, "", None), (4, "d", False, "pdf", "x.es"), (5, "e", True, None, "y.es"), (6, None, True, "pdf", "x.es"), (7, "g", None, None, "x.es")]
    df = spark.createDataFrame(rows, "p int, candidate_id string, needs_resolver boolean, extension string, source_domain string")
    run = lambda **o: (lambda got: ([r["p"] for r in got[0].collect()], tuple(got[1].first())))(R.resolver_candidates(df, spark.createDataFrame([("b",), ("b",), (None,)], "candidate_id string"), "p", **o))
    assert run(limit=9) == ([1, 3, 5, 6], (5, 1, 4)) and run(limit=2) == ([1, 3], (5, 1, 2))
    assert run(limit=9, domains=["X"]) == ([1, 6], (5, 1, 2)) and run(limit=9, ids=["a", "b"]) == ([1], (5, 1, 1))


def test_files_put_together(spark):
    rows = [("f1", 0, "a"), ("f1", 1, "a"), ("f0", 0, "b"), ("f2", 0, "b"), ("f2", 1, None), ("f2", 2, None), ("f2", 3, "")]
    got = {(r["f"], r["p"]): r["duplicate"] for r in R.consolidated(spark.createDataFrame(rows, "f string, p int, i string"), "i", "f", "p").collect()}
    assert got == {("f1", 0): False, ("f1", 1): True, ("f0", 0): False, ("f2", 0): True, ("f2", 1): False, ("f2", 2): False, ("f2", 3): False}


def test_days_as_they_are_written(spark):
    texts = [" 01/02/2024 ", "31/02/2024", "1/2/2024", "2024-02-30", "2024-02-29T10:00", " 2024-12-01", "2024-1-1", None, ""]
    got = [tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(S.day_first(F.col("t")), S.iso_day(F.col("t")).cast("string")).collect()]
    assert got == [("2024-02-01", None), ("2024-02-31", None), (None, None), (None, None), (None, "2024-02-29"), (None, "2024-12-01"), (None, None), (None, None), (None, None)]
