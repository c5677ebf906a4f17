"""Hosts in any spelling, folded texts, and small rules: records, reclassification, inputs, summaries, the sample."""

import ipaddress
import unicodedata

import pytest
from pyspark.sql import functions as F

from pliego.functions import hosts as H
from pliego.functions import notices as N
from pliego.operators import aggregates as A
from pliego.operators import gates as G
from pliego.operators import targeting as T
from pliego.operators import views as V

HOSTS = {
    "Example.com": ("dns", "example.com"), "example.com.": ("dns", "example.com"), "münchen.de": ("dns", "xn--mnchen-3ya.de"), "xn--mnchen-3ya.de": ("dns", "xn--mnchen-3ya.de"), "MÜNCHEN.de": ("dns", "xn--mnchen-3ya.de"),
    "127。0。0。1": ("ip", "127.0.0.1"), "１２７.０.０.１": ("ip", "127.0.0.1"), "8.8.8.8": ("ip", "8.8.8.8"), "::1": ("ip", "::1"), "0:0:0:0:0:0:0:1": ("ip", "::1"), "ff02::1": ("ip", "ff02::1"),
    "2130706433": ("invalid", None), "0x7f.1": ("invalid", None), "127.1": ("invalid", None), "017700000001": ("invalid", None), "0xc0.0xa8.0x1.0x1": ("invalid", None), "123.com": ("dns", "123.com"), "": ("invalid", None), None: ("invalid", None), ".": ("invalid", None),
    "a..b": ("invalid", None), "-bad-.com": ("invalid", None), "a_b.com": ("invalid", None), "a b": ("invalid", None), "x" * 64 + ".com": ("invalid", None), "日本.jp": ("dns", "xn--wgv71a.jp"), "é" * 70: ("invalid", None), "localhost": ("dns", "localhost"),
}


def test_all_spellings_of_a_host(spark):
    df = spark.createDataFrame([(h,) for h in HOSTS], "h string")
    got = {r["h"]: tuple(r["c"]) for r in df.select("h", H.canonical_host(F.col("h")).alias("c")).collect()}
    assert got == HOSTS


def test_verdicts_do_not_depend_on_the_spelling(spark):
    unsafe = ["127.0.0.1", "127。0。0。1", "10.0.0.1", "[::1]", "ff02::1", "2130706433", "localhost", "a.LOCALHOST", "x.local", "ｘ.local", "y.internal", "169.254.1.1", "0.0.0.0", "bad..host", "240.0.0.1"]
    safe = ["example.com", "8.8.8.8", "münchen.de", "xn--mnchen-3ya.de", "2001:4860:4860::8888", "local.example.com", ""]
    df = spark.createDataFrame([(h,) for h in unsafe + safe], "h string")
    assert {r["h"] for r in df.where(H.unsafe_host(F.col("h"))).collect()} == set(unsafe)
    for h in ("8.8.8.8", "2001:4860:4860::8888", "240.0.0.1"):
        assert (h in unsafe) == any(getattr(ipaddress.ip_address(h), f"is_{p}") for p in ("private", "reserved", "loopback"))


def test_whole_public_urls(spark):
    good = ["http://a.es", "HTTPS://a.es:443/x?y#z", "https://münchen.de/ñ", "http://[2001:db8::1]:80/", "http://a.es:/"]
    bad = ["a.es/x", "http://", "http:///x", "https://.", "https://-bad-.com", "https://a..b", "https://a.es:abc/x", "https://a.es:70000", "http://u:p@a.es", "http://a.es/a b", " http://a.es", "http://2130706433/", "http://127.1/", "ftp://a.es", "http://a.es\\x", "http://a​.es", "", None]
    df = spark.createDataFrame([(u,) for u in good + bad], "u string")
    assert {r["u"] for r in df.where(H.whole_public_url(F.col("u"))).collect()} == set(good)


def test_texts_without_marks(spark):
    texts = ["Ámbito", "ﬁn", "Ⅳ ½", "ÇĞŞ", "plain", "ａｂ", "Å  é\t x", "日本", "", None, "ñ" * 50]
    want = {t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower() for t in texts}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["f"] for r in df.select("t", H.fold_marks(F.col("t")).alias("f")).collect()} == want
    assert df.where("t like 'Å%'").select(H.fold_marks(F.col("t"), True)).first()[0] == "a e x"


def test_record_and_role_of_documents(spark):
    records = spark.createDataFrame([(1, "r", "k", None), (2, "r", "k", ["d2"]), (3, "r", "k", ["d3"]), (4, "r", None, []), (5, None, None, ["d5"])], "position int, record_id string, canonical_key string, documents array<string>")
    roles = spark.createDataFrame([(1, "s1", "pcap"), (2, "s1", "ppt"), (3, None, "x"), (4, "", "x")], "position int, doc_sha256 string, role string")
    docs = spark.createDataFrame([(1, "r", "k", "s1"), (2, "r", None, "s2"), (3, None, None, None), (4, "q", "k", "s1")], "i int, record_id string, canonical_key string, doc_sha256 string")
    got = {r["i"]: (r["role"], r["record_documents"]) for r in T.labelled_documents(docs, roles, records).collect()}
    assert got == {1: ("ppt", ["d2"]), 2: (None, []), 3: (None, ["d5"]), 4: ("ppt", None)}


def test_reclassification_deltas(spark):
    rows = spark.createDataFrame([(1, ["a"], ["b"], ["kb"]), (2, None, ["a"], ["ka"]), (3, ["a", "a"], None, None), (4, [], ["zz"], ["kz"]), (5, ["old"], ["b"], ["kb"])], "i int, e array<string>, p array<string>, m array<string>")
    changes = A.reclassified(rows, "i", F.col("e"), F.col("p"), F.col("m"), ["a", "b"])
    assert {r["i"]: (r["before"], r["after"], r["added"]) for r in changes.collect()} == {1: (["a"], ["a", "b"], ["b"]), 2: ([], ["a"], ["a"]), 3: (["a"], ["a"], []), 4: ([], [], []), 5: (["old"], ["old"], [])}
    got = {(r["measure"], r["value"]): (r["before"], r["after"], r["n"]) for r in A.reclassification_report(changes, ["a", "b"]).collect()}
    assert got == {
        ("records", None): (0, 0, 5), ("records_changed", None): (0, 0, 2), ("additions", None): (0, 0, 2), ("newly_classified", None): (0, 0, 1), ("unclassified", None): (2, 1, 0), ("unknown_labels", None): (0, 0, 1),
        ("label", "a"): (2, 3, 0), ("label", "b"): (0, 1, 0), ("label", "old"): (1, 1, 0), ("keyword", "kb"): (0, 0, 2), ("keyword", "ka"): (0, 0, 1), ("keyword", "kz"): (0, 0, 1),
    }


def test_input_problems(spark):
    meta, docs = "schema string, production_write_performed boolean, has_records boolean", "extraction_status string, text string, display_role string, display_label string, matched_url string"
    fine = spark.createDataFrame([("extracted", "t", "pcap", "PCAP", "http://x"), ("failed", None, None, "Documento pdf", None)], docs)
    bad = spark.createDataFrame([("extracted", "", "pcap", "Documento pdf", "x"), ("extracted", None, None, None, None)], docs)
    run = lambda m, d: {r["rule"]: r["n"] for r in G.input_problems(spark.createDataFrame(m, meta), d, "docread/1").collect()}
    assert run([("docread/1", False, True)], fine) == {} and run([("docread/1", False, True)], fine.limit(0)) == {}
    assert run([("x", True, False)], bad) == {"schema": 1, "written": 1, "records": 1, "missing_text": 2, "generic_label": 1, "invented_url": 1}
    assert run([], fine) == {"schema": 1, "written": 1, "records": 1}


@pytest.mark.parametrize(
    ("row", "language", "want"),
    [
        (("Branding", "Servicios", "Ayto", "28.500 €", "2026-04-20", "open", 3), "es", "Licitación de Branding para Ayto, con presupuesto 28.500 € y plazo hasta 20 abr 2026. · Vence en 3 días"),
        ((None, " Servicios ", None, None, None, "adjudicado", None), "es", "Licitación de Servicios para —, con presupuesto no disponible y sin plazo publicado. · Adjudicada"),
        (("", "", "Ajuntament", "1 €", "2026-09-01", "open", 8), "ca", "Licitació per a Ajuntament, amb pressupost 1 € i termini fins 1 set 2026."),
        (("Web", None, "X", None, "bad", "desierta", -1), "xx", "Licitación de Web para X, con presupuesto no disponible y sin plazo publicado. · Declarada desierta"),
    ],
)
def test_notices_in_one_sentence(spark, row, language, want):
    df = spark.createDataFrame([row], "d string, k string, o string, b string, l string, s string, n int")
    assert df.select(N.mini_summary(*(F.col(c) for c in "dkoblsn"), language)).first()[0] == want


def test_the_sample_stands_in(spark, tmp_path):
    rows, stand_in = V.or_sample(spark, lambda: spark.read.parquet(str(tmp_path / "none")), "2026-03-01")
    assert stand_in and rows.count() == 10 and rows.where("id = 's1'").first()["data_pub"] == "2026-03-01" and rows.where("id = 's3'").first()["lloc"] == "Catalunya"
    spark.range(2).write.parquet(str(tmp_path / "some"))
    assert V.or_sample(spark, lambda: spark.read.parquet(str(tmp_path / "some")), "x")[0].count() == 2
