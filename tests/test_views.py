"""Views, texts, targets and gates on small cases worked out by hand."""

import html
import re
from datetime import date, datetime

from pyspark.sql import functions as F

from pliego.functions import texts as X
from pliego.operators import evidence as E
from pliego.operators import gates as G
from pliego.operators import targeting as T
from pliego.operators import views as V
from pliego.sources import pages

AS_OF = datetime(2026, 1, 10)
ROWS = [
    ("a", "PUB", "Vigente", "2026-02-01", "CT", "2026-01-09", ["web"], "Diseño Web", "Ajuntament", ["branding"], "", True), ("b", "PUB", "Vigente", "2026-01-01", "MD", "2025-06-01", [], "Otro", None, None, "Taller SL", False),
    ("c", "ADJ", "Adjudicado", "", "CT", "2025-01-01", None, None, "Universidad", ["web"], "Taller", None),
]
SCHEMA = "id string, estat_raw string, estat string, data_limit string, ccaa string, data_pub string, disciplines array<string>, titol string, organisme string, kw array<string>, adjudicatari string, active boolean"


def test_each_filter(spark):
    rows = V.with_display(spark.createDataFrame(ROWS, SCHEMA), AS_OF)
    ids = lambda **f: "".join(sorted(r["id"] for r in V.filtered(rows, V.Filters(**f), AS_OF).collect()))
    assert (ids(), ids(status="Vigente"), ids(status="expired"), ids(active_only=True), ids(ccaa="CT"), ids(year="2025")) == ("abc", "a", "b", "a", "ac", "bc")
    assert (ids(disciplines=["web"]), ids(disciplines=[V.NO_DISCIPLINE]), ids(disciplines=["web", V.NO_DISCIPLINE]), ids(disciplines=["x"])) == ("a", "bc", "abc", "")
    assert (ids(new_only=True), ids(query="WEB"), ids(query="univ"), ids(query="brand"), ids(awardee="taller"), ids(awardee="taller sl", ccaa="MD")) == ("a", "ac", "c", "a", "bc", "b")
    assert [r["id"] for r in V.map_rows(rows, V.Filters(status="Vigente", disciplines=["web"])).collect()] == ["a"]


def test_pages_are_kept_within_bounds(spark):
    rows = spark.createDataFrame([(i, "open" if i % 2 else "x", float(i) if i % 5 else None) for i in range(23)], "id int, display string, v double")
    got = V.page(rows, 99, 5, "v").collect()
    assert [r["id"] for r in got] == [0, 10, 20]
    first = V.page(rows, 0, 5, "v").collect()
    assert [r["id"] for r in first] == [1, 3, 7, 9, 11] and {(r["page"], r["pages"], r["total"]) for r in first} == {(1, 5, 23)}
    assert V.page(rows.limit(0), 1, 5, "v").collect() == []
    assert V.neighbour_period(2025, 1, -1, 2024, 2026) == (2024, 3) and V.neighbour_period(2024, 1, -1, 2024, 2026) == (2024, 1) and V.neighbour_period(2026, 3, 1, 2024, 2026) == (2026, 3)


def test_tiers_fall_back_to_the_whole(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2026"), (2, "2025"), (3, "archive")], "id int, shard string")
    rows.write.partitionBy("shard").parquet(str(tmp_path / "s"))
    rows.write.parquet(str(tmp_path / "whole"))
    levels = {1: ["2026", "2025"], 3: ["archive"]}
    assert [sorted(r["id"] for r in t.collect()) for t in V.tiers(spark, str(tmp_path / "s"), levels, str(tmp_path / "whole"))] == [[1, 2], [3]]
    assert [t.count() for t in V.tiers(spark, str(tmp_path / "s"), levels | {2: ["missing"]}, str(tmp_path / "whole"))] == [3]


def test_markup_goes(spark):
    for raw in ("<p>a &amp; b</p>\n c", "Dise&ntilde;o&nbsp;x", "&#233;&#xE9; &lt;b&gt;", "", "a<br/>b", "&bogus; &"):
        got = spark.range(1).select(X.strip_html(F.lit(raw))).first()[0]
        assert got == re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", html.unescape(raw))).strip(), raw


def test_labels_and_roles(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.label(F.lit(" 4 1 ANEXO I  economica .xlsx"))) == "ANEXO I economica.xlsx" and one(X.clean_line(F.lit("a(cid:12)  b"))) == "a b"
    for label, role in (("Pliego de prescripciones técnicas", "ppt"), ("Pliego administrativo", "pcap"), ("Declaración responsable", "declaracion"), ("Modelo de oferta", "modelo"), ("Anexo I", "anexo"), ("Pliego", "other")):
        assert one(X.role_of_label(F.lit(label))) == role
    for text, role in (("Documento de Pliegos\nx", "documento_pliegos"), ("Anuncio previo", "anuncio_previo"), ("x\ny\nz\nAnuncio de licitación Número de Expediente Sello de tiempo", "anuncio_placsp"), ("x formalización del contrato", "acta"), ("x", "unknown")):
        assert one(X.role_of_text(F.lit(text)))["role"] == role
    assert one(X.snippet(F.lit(b"a\n\x01b" + b"c" * 300)))[:3] == "a b" and len(one(X.snippet(F.lit(b"c" * 300)))) == 160
    assert one(X.split_codes(F.lit(" 1, ,2"))) == ["1", "2"] and one(X.cap_first(F.lit("ab"))) == "Ab" and one(X.escape_html(F.lit('<a b="&">'))) == "&lt;a b=&quot;&amp;&quot;&gt;"


def test_targets_by_the_sequential_rule(spark):
    import random

    r = random.Random(2)
    docs = [(r.randrange(30), i, "feed_xml" if r.random() < 0.9 else "x", r.choice([T.LEGAL, T.TECHNICAL, "other"]), f"http://x/{r.randrange(60)}" if r.random() < 0.9 else "") for i in range(200)]
    seen, want, records = set(), [], set()
    for rec in sorted({d[0] for d in docs}):
        own = [d for d in docs if d[0] == rec and d[2] == "feed_xml" and d[4].startswith("http")]
        legal, tech = ([d for d in own if d[3] == s] for s in (T.LEGAL, T.TECHNICAL))
        turns = [x for k in range(len(own)) for x in (legal[k : k + 1] + tech[k : k + 1])][:3]
        if len(records) >= 12 or len(want) >= 25:
            break
        for d in turns:
            if len(want) < 25 and d[4] not in seen:
                seen.add(d[4])
                want.append((rec, d[4]))
                records.add(rec)
    df = spark.createDataFrame(docs, "rec int, pos int, provenance string, source_section string, url string")
    assert [(x["rec"], x["url"]) for x in T.select_targets(df, [F.col("rec")], "rec", "pos", 12, 25, 3).collect()] == want


def test_eligibility(spark):
    award = "array<struct<winning_party_name:string>>"
    rows = [("2026-01-01", True, "", None, None), ("2024-01-01", True, "", None, None), ("2025-01-01", True, "", [("W",)], None), ("2025-01-01", None, "", None, None), ("2025-01-01", True, "X", None, None), ("2025-01-01", True, " ", [("",)], "")]
    df = spark.createDataFrame(rows, f"data_pub string, active_opportunity_eligible boolean, adjudicatari string, award_results {award}, winner_provenance string")
    assert [r[0] for r in df.select(T.record_eligible()).collect()] == [True, False, False, False, False, True]
    docs = spark.createDataFrame([(("f2b_resolver", "application/pdf", "u", None, ""),), (("f2b_resolver", "application/pdf", "u", 404, ""),), (("f2b_resolver", "application/pdf", "u", 200, "ACTA_ADJ"),)], "d struct<provenance:string,mime_hint:string,url:string,http_status:int,document_type:string>")
    assert [r[0] for r in docs.select(T.document_eligible(F.col("d"))).collect()] == [True, False, False]
    assert spark.range(1).select(T.deadline_valid(F.lit("2026-01-02T10"), date(2026, 1, 2)), T.deadline_valid(F.lit("x"), date(2026, 1, 2))).first()[:] == (True, False)


def test_references_find_their_section(spark):
    refs = spark.createDataFrame([(1, "pcap"), (1, "ppt"), (1, "anexo"), (1, "odd"), (2, "pcap")], "rec int, role string")
    docs = spark.createDataFrame([(1, 0, "feed_xml", T.LEGAL, "u1"), (1, 1, "feed_xml", T.TECHNICAL, "u2"), (1, 2, "feed_xml", T.TECHNICAL, "u3"), (1, 3, "feed_xml", "additionalpublicationdocumentreference", ""), (2, 0, "x", T.LEGAL, "u")], "rec int, position int, provenance string, source_section string, url string")
    got = {(r["rec"], r["role"]): (r["confidence"], r["url"], r["resolvable"]) for r in T.matched_references(refs, docs, "rec").collect()}
    assert got == {(1, "pcap"): ("high", "u1", True), (1, "ppt"): ("medium", "u2", True), (1, "anexo"): ("low", None, False), (1, "odd"): ("none", None, False), (2, "pcap"): ("none", None, False)}


def test_fields_and_status(spark):
    rows = spark.createDataFrame([("v", "extracted", "low", "e"), ("v", "extracted", "high", ""), ("v", "extracted", "high", "e"), (None, "null", None, None)], "v string, s string, c string, e string")
    got = [tuple(r["x"]) for r in rows.select(G.enforced(F.col("v"), F.col("s"), F.col("c"), F.col("e"), "medium", True).alias("x")).collect()]
    assert got == [(None, "below_min_confidence"), (None, "insufficient_evidence"), ("v", "extracted"), (None, "null")]
    state = lambda names, deferred, role="anuncio_placsp": spark.range(1).select(G.appendix_status(F.lit(True), F.lit(role), F.array(*map(F.lit, names)), F.lit(deferred))).first()[0]
    assert (state(["objeto", "cpv", "duracion"], False), state(["objeto", "cpv", "duracion"], True), state(["cpv"], False), state(["x"], False), state(["objeto", "cpv", "duracion"], False, "pcap")) == ("ready", "partial", "partial", "insufficient_text", "insufficient_text")
    kinds = spark.createDataFrame([(["b"], ["a"]), (["b"], ["zz"]), (None, None)], "o array<string>, n array<string>").select(G.known_labels(F.col("o"), F.col("n"), ("a", "b")).alias("k")).collect()
    assert [r["k"] for r in kinds] == [["a", "b"], ["b"], []]
    shapes = spark.createDataFrame([('{"data": [], "meta": {}}',), ('{"data": {}}',), ("[]",), ("no",), (None,)], "j string").select(G.structure_issues(F.col("j")).alias("i")).collect()
    assert [r["i"] for r in shapes] == [[], ["no_data_list", "no_meta"], ["not_an_object"], ["not_an_object"], ["not_an_object"]]


def test_freshness_fails_closed(spark):
    runs = spark.createDataFrame([(["a", "b", "c"], ["a", "b"], ["b"], "2026-01-01"), (None, None, None, "2026-02-01")], "requested array<string>, completed array<string>, failed array<string>, generated_at string")
    cover = G.source_coverage(runs)
    assert sorted(map(tuple, cover.collect())) == [("a", "ok", "2026-01-01"), ("b", "failed", None), ("c", "degraded", None)]
    assert tuple(G.freshness(cover).first()) == ("2026-01-01", True) and tuple(G.freshness(cover.where("status <> 'ok'")).first()) == (None, False)


def test_link_candidates_of_a_page(spark):
    """The best candidates: one for each address, titled and sure first, no markup variant beside a PDF."""
    html_ = '<a href="docs/pliego.pdf">Pliego de cláusulas administrativas</a><a href="docs/pliego.pdf"></a><a href="/servlet?docId=7&f=html">Documento html</a><a href="/servlet?docId=7&f=pdf">Documento pdf</a><a href="/x">nada</a>'
    links = pages.links(spark.createDataFrame([(1, html_)], "page_id int, html string")).withColumn("page", F.lit("https://h.org/a/b"))
    got = [(r["url"], r["kind"], r["confidence"]) for r in E.best_candidates(E.described(links, "page"), "page_id", "position").orderBy("position").collect()]
    assert got[0] == ("https://h.org/a/docs/pliego.pdf", "pliego_admin", "high") and len([g for g in got if "pliego.pdf" in g[0]]) == 1
    assert not any(g[0].endswith("f=html") for g in got) and any(g[0].endswith("f=pdf") for g in got) and not any(g[0].endswith("/x") for g in got)
