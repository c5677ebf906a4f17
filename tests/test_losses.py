"""Nothing is lost without a sign: null lists, deep trees, broken files, unreadable logs, even counts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pliego.functions.notices import score
from pliego.functions.semantics import upper_median
from pliego.operators import evidence as E
from pliego.operators import merge as M
from pliego.operators import privacy as X
from pliego.sources import feeds
from pliego.streaming import landing

LISTS = "key string, estat string, adjudicatari string, docs array<string>"


def test_lifecycle_merge_keeps_lists_beside_null_ones(spark):
    production = spark.createDataFrame([("a", "vigente", "", ["d1"], "CLEAR_OPEN", False), ("b", "vigente", "", None, "CLEAR_OPEN", False), ("c", "vigente", "", None, "CLEAR_OPEN", False), ("d", "x", "", ["d1", "d1"], None, None)], LISTS + ", lifecycle_category string, lifecycle_review_required boolean")
    candidates = spark.createDataFrame([("a", "vigente", "W", None, 0), ("b", "vigente", "", ["d2"], 1), ("c", "vigente", "", None, 2), ("d", "x", "", ["d2", "d1", "d2"], 3)], LISTS + ", pos int")
    got = {r["key"]: r for r in M.lifecycle_merge(production, candidates, "key", "pos", [], ["docs"], conflicts=True).collect()}
    assert {k: r["docs"] for k, r in got.items()} == {"a": ["d1"], "b": ["d2"], "c": None, "d": ["d1", "d1", "d2"]}
    assert [tuple(c) for c in got["a"]["conflicts"]] == [("adjudicatari", "", "W")] and got["b"]["conflicts"] == []


AWARD = "struct<notice_id:string,notice_type:string,winning_party_name:string,winning_party_nif:string,award_amount_tax_excl:double,contract_id:string,lot_id:string>"
FULL = (
    "ckey string, id string, notice_type string, estat string, adjudicatari string, data_pub string, data_limit string, titol string, url string, cpv string, disciplines array<string>, pressupost double, "
    f"award_results array<{AWARD}>, documents array<struct<title:string,url:string,document_type:string,notice_id:string>>, notice_history array<struct<notice_id:string,notice_type:string,issue_date:string>>, "
    "related_contract_ids array<string>, historial array<struct<data:string,estat:string,nota:string>>"
)


def test_rank_merge_carries_the_whole_record(spark):
    award = lambda n, t, w: (n, t, w, "", 1.0, None, None)
    previous = [("k", "old", "PUB", "Vigente", "", "2024-01-01", "2024-02-01", "Old title", "", "22, 79", ["web"], 5.0, [award("n1", "RES", "First")], [("A", "u", "t", "n1")], [("n1", "PUB", "d")], ["r2"], [("d", "Vigente", "x")])]
    incoming = [("k", "new", "AWARD", "Adjudicado", "", "2024-03-01", "", "New title", "http://x", "92,79", None, None, [award("n2", "AWARD", "Best"), award("n1", "RES", "First"), award("n3", "AWARD", "Late")], [("A", "u", "t", "n1"), ("B", "u", "t", "n2")], None, ["r1", "r2"], None)]
    r = M.rank_merge(spark.createDataFrame(previous, FULL), spark.createDataFrame(incoming, FULL), "2024-04-01").first()
    assert (r["id"], r["titol"], r["url"], r["cpv"], r["disciplines"], r["pressupost"], r["data_limit"]) == ("old", "New title", "http://x", "22,79,92", ["web"], 5.0, "2024-02-01")
    assert [a["winning_party_name"] for a in r["award_results"]] == ["Best", "First", "Late"] and [d["title"] for d in r["documents"]] == ["A", "B"]
    assert r["related_contract_ids"] == ["r1", "r2"] and len(r["notice_history"]) == 1 and [h["nota"] for h in r["historial"]] == ["x", "Cambio: Vigente → Adjudicado"]
    assert (r["adjudicatari"], r["winner_provenance"], r["estat"]) == ("Best", "feed_xml", "Adjudicado")


def test_deep_trees_are_scanned_to_the_ground(spark):
    deep = {"mail": "x"}
    for k in range(40):
        deep = {f"k{k}": [deep]} if k % 2 else {"n": deep}
    bottom = json.dumps(deep).replace('"x"', '"who@example.com"')
    docs = spark.createDataFrame([(1, bottom), (2, "{no json: who@example.com"), (3, None), (4, '{"a/b": 1.50, "a/b": "two", "c": []}'), (5, "[" * 100_000)], "i int, j string")
    leaves = X.json_leaves(docs, "i", "j").collect()
    assert [r["value"] for r in leaves if r["i"] == 1] == ["who@example.com"]
    assert sorted((r["pointer"], r["value"]) for r in leaves if r["i"] == 4) == [("/a~1b", "1.50"), ("/a~1b", "two")]
    found = {(r["i"], r["rule"]) for r in X.tree_findings(docs, "i", "j", "public-diagnostic").collect()}
    assert {(1, "EMAIL_VALUE"), (1, "EMAIL_KEY"), (2, "EMAIL_VALUE")} <= found and any(r["i"] == 5 for r in leaves)


RULES = [
    ({"contact_phone": "1"}, "CONTACT_KEY"), ({"databasePassword": "hunter2"}, "CREDENTIAL_KEY"), ({"contraseña": "x"}, "CREDENTIAL_KEY"), ({"correo_electrónico": "x"}, "EMAIL_KEY"),
    ({"operator_dni": "x"}, "PERSONAL_ID_KEY"), ({"winning_party_nif": "B1"}, "POPULATED_WINNING_PARTY_NIF"), ({"raw_body": "x"}, "RAW_PAYLOAD_CARRIER"), ({"nota": "+34 600 111 222"}, "CONTACT_VALUE"),
    ({"nota": "Tel: 612 345 678"}, "CONTACT_VALUE"), ({"nota": "12345678Z"}, "PERSONAL_ID_VALUE"), ({"nota": "DNI 12345678A"}, "PERSONAL_ID_VALUE"), ({"nota": r"C:\x"}, "WINDOWS_ABS_PATH"),
    ({"nota": r"\\host\share"}, "UNC_PATH"), ({"nota": "/home/me/x"}, "UNIX_HOME_PATH"), ({"nota": "see javascript:alert(1)"}, "DANGEROUS_URL_SCHEME"), ({"url": "not a url"}, "DANGEROUS_URL_SCHEME"),
    ({"nota": "http:127.0.0.1/x"}, "UNSAFE_URL_HOST"), ({"nota": "https://a:b@example.com/"}, "UNSAFE_URL_HOST"), ({"nota": "http://2130706433/"}, "UNSAFE_URL_HOST"), ({"nota": "_tmp/x"}, "RELATIVE_TMP_PATH"),
    ({"font": "LOCAL"}, "LOCAL_MARKER"), ({"source_file": None}, "FAMILY_SOURCE_FILE"), ({"dry_run_mode": 1}, "BOOKKEEPING_FIELD"), ({"strange": 1}, "SCHEMA_UNKNOWN"),
    ({"nota": "write to who@example.com"}, "EMAIL_VALUE"), ({"nota": "-----BEGIN RSA PRIVATE KEY-----"}, "PRIVATE_KEY_BLOCK"), ({"nota": "Bearer abcdefghijk"}, "CREDENTIAL_VALUE"), ({"12345678Z": 1}, "PERSONAL_ID_VALUE"),
]
CLEAN = [{"password": ""}, {"winning_party_nif": None}, {"canonical_key": "x"}, {"nota": "2019/00014032E"}, {"nota": "612 345 678"}, {"nota": "Data: 2026-01-01"}, {"url": "https://example.com/a?b=c"}, {"url": ""}, {"estat_raw": "PUB"}, {"nota": "HTTP: 2026"}]


@pytest.mark.parametrize("surface", ["public-build", "public-diagnostic", "internal-ephemeral"])
def test_every_privacy_rule(spark, surface):
    rows = [(i, json.dumps({"data": [tree]})) for i, tree in enumerate([t for t, _ in RULES] + CLEAN)]
    df = spark.createDataFrame(rows, "i int, j string")
    got = {}
    for r in X.tree_findings(df, "i", "j", surface).collect():
        got.setdefault(r["i"], set()).add((r["rule"], r["severity"]))
    for i, (tree, rule) in enumerate(RULES):
        public, warn = surface != "internal-ephemeral", surface == "public-build"
        want = "ERROR" if rule in X.HARD or rule in X.PUBLIC and public else "WARN" if rule in X.HYGIENE and warn else None
        assert ((rule, want) in got.get(i, set())) == (want is not None), (tree, rule)
    for i in range(len(RULES), len(rows)):
        assert not any(s == "ERROR" for _, s in got.get(i, ())), rows[i]
    if surface == "public-build":
        assert {r for t, r in RULES} == set(X.HARD) | set(X.PUBLIC) | set(X.HYGIENE)
        hidden = X.tree_findings(df, "i", "j", surface).where("rule = 'CREDENTIAL_KEY'").select("pointer").first()[0]
        assert hidden == "/data[0]/__redacted_key_0__"
        verdicts = {r["i"]: r["outcome"] for r in X.outcome(X.tree_findings(df, "i", "j", surface), df, "i").collect()}
        assert verdicts[0] == "FAIL" and verdicts[23] == "WARN" and verdicts[len(RULES) + 6] == "PASS"


ENTRY = """<entry><id>http://n/1</id><a:ContractFolderID>F1</a:ContractFolderID><a:ContractFolderStatusCode>FOR</a:ContractFolderStatusCode><a:NoticeTypeCode>DOC</a:NoticeTypeCode>
<a:TenderResult><a:ResultCode>8</a:ResultCode><a:AwardDate>2024-05-06T00:00</a:AwardDate><a:WinningParty><a:PartyName><a:Name>ES 41</a:Name></a:PartyName><a:CompanyID>123</a:CompanyID><a:CompanyID>B1234567</a:CompanyID></a:WinningParty>
<a:Name>Taller</a:Name><a:TaxExclusiveAmount>abc</a:TaxExclusiveAmount><a:TaxExclusiveAmount>10,5</a:TaxExclusiveAmount><a:PayableAmount>12</a:PayableAmount><a:LotID>2</a:LotID><a:ContractID>C1</a:ContractID></a:TenderResult>
<a:TenderResult><a:ResultCode>3</a:ResultCode></a:TenderResult>
<a:LegalDocumentReference><a:ID>Pliego</a:ID><a:Name>P</a:Name><a:URI>http://x/d.pdf?x=1</a:URI><a:DocumentReference><a:URI>http://x/e.docx</a:URI><a:IssueDate>2024-01-02Z</a:IssueDate></a:DocumentReference></a:LegalDocumentReference></entry>"""


def test_nested_lists_of_an_entry(spark):
    rows = spark.createDataFrame([("f", f"<feed>{ENTRY}</feed>", )], "file string, xml string")
    r = feeds.details(feeds.entries(rows).withColumn("issued", F.lit("2024-06-07T08:00")), "issued").first()
    assert (r["folder_id"], r["notice_type_code"], r["notice_type"], r["related_contract_ids"], r["winning_party_nif"], r["formalization_date"]) == ("F1", "DOC", "FORMALIZATION", ["C1"], "B1234567", "2024-06-07")
    a, b = r["award_results"]
    assert (a["result_code"], a["award_date"], a["winning_party_name"], a["winning_party_nif"], a["award_amount_tax_excl"], a["award_amount_tax_incl"], a["lot_id"], a["contract_id"], a["notice_id"]) == ("8", "2024-05-06", "Taller", "B1234567", 10.5, 12.0, "2", "C1", "http://n/1")
    assert (b["result_code"], b["winning_party_name"], b["lot_id"]) == ("3", "", None)
    assert [(d["source_section"], d["title"], d["url"], d["mime_hint"], d["format_hint"], d["published_at"]) for d in r["documents"]] == [
        ("legaldocumentreference", "P", "http://x/d.pdf?x=1", "application/pdf", "PDF", "2024-01-02"), ("documentreference", "", "http://x/e.docx", feeds.MIME_BY_EXTENSION["docx"], "DOCX", "2024-01-02"),
    ]


def test_a_broken_feed_stops_no_other(spark, tmp_path):
    (tmp_path / "a.atom").write_text(f"<feed>{ENTRY}</feed>")
    (tmp_path / "b.atom").write_text(f"<feed>{ENTRY}<entry><id>x</i></entry></feed>")
    files = spark.read.text(str(tmp_path), wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("xml"))
    assert [r["id"] for r in feeds.parsed(feeds.entries(files)).collect()] == ["http://n/1"]
    assert [r["file"].rsplit("/", 1)[1] for r in feeds.malformed(files).collect()] == ["b.atom"]


def test_an_unreadable_log_is_an_error_not_a_new_start(spark, tmp_path):
    kept = landing.Snapshots(spark, str(tmp_path / "t"))
    assert kept.read(0) is None
    kept.write(spark.range(3), 0)
    assert kept.read(1).count() == 3 and kept.read(0) is None
    for part in (tmp_path / "t" / "log").glob("*.parquet"):
        part.write_bytes(b"broken")
    for crc in (tmp_path / "t" / "log").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="(?i)parquet|footer|file"):
        kept.read(1)


def test_upper_median_of_even_and_odd_counts(spark):
    r = random.Random(3)
    for n in (1, 2, 3, 4, 9, 10):
        values = [r.randint(0, 5) for _ in range(n)]
        assert spark.createDataFrame([(v,) for v in values], "v int").agg(upper_median("v")).first()[0] == sorted(values)[n // 2]


def test_score_counts_as_before(spark):
    rows = spark.createDataFrame([("Branding y logotipo", "Diseño  gráfico, branding y marca", ["79340000"]), ("Obra", "nada", ["79340000"]), (None, None, None)], "t string, d string, c array<string>")
    assert [r[0] for r in rows.select(score(F.col("t"), F.col("d"), F.col("c"))).collect()] == [15 + 10 + 12 + 4 + 20, 0, 0]  # branding, logotipo and logotip within it


def test_addresses_are_resolved_against_their_page(spark):
    from urllib.parse import urljoin

    base = "https://x.org/a/b/c.html?q=1"
    for href in ("d.pdf", "./d.pdf", "../d.pdf", "../../../d.pdf", "/d.pdf?x=2", "//y.org/d", "http://z/d", "?p=2", "#part", "", "e/f/../g.pdf#h", "mailto:a@b"):
        got = spark.range(1).select(E.absolute_url(F.lit(base), F.lit(href))).first()[0]
        assert got == (base if href == "" else urljoin(base, href)), href


def test_resolution_blocks_what_the_rules_block(spark):
    rows = [("http://x/a.pdf", 200, "application/pdf; q", None, "pdf", "c", "k"), ("http://x/a", 404, "text/html", None, "", None, ""), ("http://x/a", 206, "application/octet-stream", "attachment; filename*=UTF-8''pl%C3%A9c.docx", "", "c", "k"), (None, None, None, None, None, "c", "k")]
    df = spark.createDataFrame(rows, "u string, s int, m string, d string, g string, c string, k string")
    got = [r["r"] for r in df.select(E.resolution(*(F.col(c) for c in "usmdgck")).alias("r")).collect()]
    assert got[0]["is_pdf"] and got[0]["blockers"] == [] and got[0]["merge_ready"] and got[2]["filename"] == "pléc.docx" and got[2]["merge_ready"]
    assert got[1]["blockers"] == ["not_resolved", "not_document", "html_page", "no_candidate_id", "no_canonical_key"] and got[3]["blockers"] == ["not_resolved", "not_document", "no_final_url"]


def test_rows_without_a_key_keep_their_fields(spark):
    row = lambda key, title: spark.createDataFrame([(key, "PUB", "Vigente", "", "2024-01-01", [], title)], "ckey string, notice_type string, estat string, adjudicatari string, data_pub string, historial array<struct<data:string,estat:string,nota:string>>, titol string")
    merged = M.rank_merge(row(None, "old"), row(None, "new").unionByName(row("k", "keyed")), "2024-04-01").collect()
    assert sorted((r["titol"], r["ckey"] or "", r["outcome"]) for r in merged) == [("keyed", "k", "new"), ("new", "", "new"), ("old", "", "preserved")]
    assert all(r["data_pub"] == "2024-01-01" and r["notice_type"] == "PUB" for r in merged)


def test_legacy_rows_without_an_id_keep_their_fields(spark):
    from pliego.operators.records import legacy_merge

    ddl = "id string, estat string, adjudicatari string, data_pub string, historial array<struct<data:string,estat:string,nota:string>>, titol string"
    merged = legacy_merge(spark.createDataFrame([(None, "Vigente", "", "d", [], "old")], ddl), spark.createDataFrame([(None, "Vigente", "", "d", [], "new")], ddl), "2024-04-01", ["titol"]).collect()
    assert sorted((r["titol"], r["outcome"]) for r in merged) == [("new", "new"), ("old", "preserved")]


def test_a_data_set_without_meta_fails(spark):
    from pliego.operators import gates as G

    records = spark.createDataFrame([("CLEAR_OPEN", True)], "lifecycle_category string, active_opportunity_eligible boolean")
    meta = spark.createDataFrame([], "schema string, publication_state string, generation_id string, dataset_sha256 string")
    found = G.production_validation(records, meta, "s/1", "published").collect()
    assert [(r["verdict"], r["issues"], r["records"]) for r in found] == [("FAIL", ["schema"], 1)]
    none = spark.createDataFrame([], "id int, y int, shard string")
    assert G.shard_validation(none, none, "id", "y", (2024,)).first()["issues"] == ["no_records"]


def test_damaged_entries_and_members_cost_nothing_else(spark, tmp_path):
    import io
    import zipfile

    rows = spark.createDataFrame([("f", 0, '<entry><id xsi:type="a">1</id><TenderResult><ResultCode>8</ResultCode></TenderResult></entry>'), ("f", 1, "<entry><id>2</entry>"), ("f", 2, None)], "file string, position int, entry string").where("entry is not null")
    got = {r["position"]: r for r in feeds.details(rows).collect()}
    assert got[0]["award_results"][0]["result_code"] == "8" and got[0]["award_results"][0]["notice_id"] == "1" and got[0]["reason"] is None
    assert got[1]["award_results"] is None and "mismatched" in got[1]["reason"]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name in "abc":
            z.writestr(f"{name}.atom", f"<feed><entry><id>{name}</id></entry></feed>" + "x" * 300 * (name == "b"))
    data = bytearray(buffer.getvalue())
    at = data.find(b"b.atom") + 6
    data[at : at + 12] = b"\xff" * 12
    (tmp_path / "z.zip").write_bytes(bytes(data))
    (tmp_path / "no.zip").write_bytes(b"nothing")
    found = {r["file"].rsplit("/", 1)[1]: r for r in feeds.read_archives(spark, str(tmp_path)).collect()}
    assert sorted(found) == ["no.zip", "z.zip!a.atom", "z.zip!b.atom", "z.zip!c.atom"]
    assert found["z.zip!b.atom"]["xml"] is None and found["z.zip!b.atom"]["reason"] and found["no.zip"]["reason"] and found["z.zip!c.atom"]["reason"] is None
    assert sorted(r["id"] for r in feeds.parsed(feeds.entries(feeds.read_archives(spark, str(tmp_path)))).collect()) == ["a", "c"]


def test_nested_elements_are_found_once_each(spark):
    xml = "<entry><id>1</id><TenderResult><ResultCode>8</ResultCode><TenderResult><ResultCode>9</ResultCode><!-- x --></TenderResult></TenderResult><ResultCode>7</ResultCode></entry>"
    r = feeds.details(spark.createDataFrame([("f", 0, xml)], "file string, position int, entry string")).first()
    assert [a["result_code"] for a in r["award_results"]] == ["8", "9"]


def test_damaged_shards_give_way_to_the_whole(spark, tmp_path):
    from pliego.operators import views as V
    from pliego.sources.exports import file_manifest

    rows = spark.range(3000).selectExpr("id", "uuid() AS t", "id % 2 AS shard")
    rows.write.partitionBy("shard").parquet(str(tmp_path / "s"))
    rows.write.parquet(str(tmp_path / "whole"))
    manifest = file_manifest(spark, str(tmp_path / "s"), "shard")
    manifest = spark.createDataFrame(manifest.collect(), manifest.schema)
    levels = {1: ["0"], 2: ["1"]}
    assert [t.count() for t in V.tiers(spark, str(tmp_path / "s"), levels, str(tmp_path / "whole"), manifest=manifest)] == [1500, 1500]
    part = next((tmp_path / "s" / "shard=1").glob("part-*"))
    data = bytearray(part.read_bytes())
    data[100:400] = bytes(300)
    part.write_bytes(bytes(data))
    for crc in (tmp_path / "s" / "shard=1").glob(".*.crc"):
        crc.unlink()
    assert [t.count() for t in V.tiers(spark, str(tmp_path / "s"), levels, str(tmp_path / "whole"), manifest=manifest)] == [3000]
    with pytest.raises(Exception, match="(?i)data.?source"):
        list(V.tiers(spark, str(tmp_path / "s"), levels, str(tmp_path / "whole"), form="no_such_format"))


def test_all_names_of_characters(spark):
    import html

    from pliego.functions.texts import unescaped

    for text in ("a &times; b &deg; &copy;", "&amp;lt; &lt; &#38;gt; &gt;", "&notaname; &AMP;", "&NotEqualTilde;&eacute;&#x20AC;&#8364;", "&copy 2020 &copyx &notin; &not &ampamp;", "no references"):
        assert spark.range(1).select(unescaped(F.lit(text))).first()[0] == html.unescape(text), text
