"""Readers, writers and streams on small made-up files."""

import json
import os
import zipfile

from pyspark.sql import functions as F

from pliego.operators.dedup import best_of
from pliego.sources import feeds, json_files, pages
from pliego.streaming import landing

ENTRY = """<entry><id>{i}</id><title>Branding {i}</title><link href="http://x/{i}"/><updated>2026-01-0{i}</updated>
<cac-place-ext:ContractFolderStatus><cbc:ContractFolderID>F{i}</cbc:ContractFolderID><cbc-place-ext:ContractFolderStatusCode listURI="u">PUB</cbc-place-ext:ContractFolderStatusCode>
<cac:BudgetAmount><cbc:TaxExclusiveAmount currencyID="EUR">1000.5</cbc:TaxExclusiveAmount><cbc:TaxInclusiveAmount>1200</cbc:TaxInclusiveAmount></cac:BudgetAmount>
<cac:LocatedContractingParty><cac:Party><cac:PartyName><cbc:Name>Ayuntamiento de X</cbc:Name></cac:PartyName></cac:Party></cac:LocatedContractingParty>
<cac:TenderSubmissionDeadlinePeriod><cbc:EndDate>2026-02-03T00:00</cbc:EndDate></cac:TenderSubmissionDeadlinePeriod>
<cac:ProcurementProject><cbc:ItemClassificationCode>79340000</cbc:ItemClassificationCode><cbc:ItemClassificationCode>0123</cbc:ItemClassificationCode></cac:ProcurementProject>
</cac-place-ext:ContractFolderStatus></entry>"""
FEED = '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:cac="urn:a">{}</feed>'


def test_feed_entries_and_fields(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.atom").write_text(FEED.format(ENTRY.format(i=1) + ENTRY.format(i=2)))
    (tmp_path / "y.atom").write_text("<feed><entry>cut")
    rows = feeds.parsed(feeds.read_entry_texts(spark, str(tmp_path))).orderBy("position").collect()
    assert [r["id"] for r in rows] == ["1", "2"]
    r = rows[0]
    assert (r["folder_id"], r["status"], r["status_code"], r["budget"], r["deadline"], r["organisation"], r["cpv"], r["link"]) == ("F1", "Vigente", "PUB", 1200.0, "2026-02-03", "Ayuntamiento de X", ["79340000"], "http://x/1")


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in.atom", FEED.format(ENTRY.format(i=1)))
        z.writestr("skip.txt", "x")
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    assert [r["id"] for r in feeds.parsed(feeds.entries(feeds.read_archives(spark, str(tmp_path)))).collect()] == ["1"]


def test_json_shapes_and_key_presence(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"meta": {}, "data": [{"id": "1", "x": None}, {"id": "1", "y": 2}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"id": "2"}]))
    rows = json_files.typed(json_files.read_records(spark, str(tmp_path)), "id string, x string, y int")
    assert sorted((r["id"], tuple(r["keys"])) for r in rows.collect()) == [("1", ("id", "x")), ("1", ("id", "y")), ("2", ("id",))]
    assert {(r["id"], r["y"]) for r in json_files.last_by_id(rows).collect()} == {("1", 2), ("2", None)}


def test_csv_is_quoted(spark, tmp_path):
    json_files.write_csv(spark.createDataFrame([('a"b', ["x", "y"])], "s string, l array<string>"), str(tmp_path / "o"), ["l"])
    text = "".join(p.read_text() for p in (tmp_path / "o").glob("*.csv"))
    assert '"a""b";"x,y"' in text


def test_page_links(spark):
    html = '<table><tr><td>Pliego <a href="/a.pdf" title="T"><img alt="icono"/></a></td></tr></table><a href="b">B <b>C</b></a><a href=c></a>'
    rows = pages.links(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")).orderBy("position").collect()
    assert [(r["href"], r["text"], r["context"]) for r in rows] == [("/a.pdf", "icono", "T"), ("b", "B C", ""), ("c", "", "")]


def test_runs_merge_into_a_retained_table(spark, tmp_path):
    land, keep = tmp_path / "land", landing.Snapshots(spark, str(tmp_path / "keep"))
    land.mkdir()

    def merge(previous, incoming):
        return best_of(previous.unionByName(incoming), ["k"], [F.col("v")])

    for i, rows in enumerate(([{"k": 1, "v": 5}, {"k": 2, "v": 1}], [{"k": 1, "v": 3}, {"k": 3, "v": 9}])):
        (land / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        stream = landing.landed(spark, str(land), "k int, v int")
        landing.merged_runs(stream, keep, merge, str(tmp_path / "cp")).awaitTermination()
    assert {tuple(r) for r in keep.read(10**9).collect()} == {(1, 5), (2, 1), (3, 9)}


def test_late_repeats_are_dropped(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.json").write_text('{"k": 1, "t": "2024-01-01T00:00:00"}\n{"k": 1, "t": "2024-01-01T00:01:00"}\n{"k": 2, "t": "2024-01-01T00:02:00"}')
    seen = landing.first_seen(landing.landed(spark, str(src), "k int, t timestamp"), ["k"], "t", "1 hour")
    q = seen.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["k"] for r in spark.sql("SELECT k FROM seen").collect()) == [1, 2]


def test_a_batch_rewrites_the_parts_it_touches(spark, tmp_path):


    kept = landing.PartedSnapshots(spark, str(tmp_path / "keep"), "k", parts=8)
    merge = lambda old, new: old.join(new, "k", "left_anti").unionByName(new)  # noqa: E731  the new row of a key counts
    assert kept.read() is None
    rows = lambda *pairs: spark.createDataFrame(pairs, "k int, v string")
    first = kept.merge(rows(*((i, "a") for i in range(40)), (None, "a")), 0, merge)
    assert len(first) == 9 and kept.read().count() == 41
    assert len(kept.merge(rows((3, "b"), (100, "b")), 1, merge)) <= 2 and len(os.listdir(tmp_path / "keep" / "v1")) <= 5
    assert {r["k"]: r["v"] for r in kept.read().collect()} == {**{i: "a" for i in range(40)}, 3: "b", 100: "b", None: "a"}
    kept.merge(rows((3, "b"), (100, "b")), 1, merge)
    assert kept.read().count() == 42 and kept.read(1).count() == 41
    assert kept.merge(rows(), 2, merge) == [] and kept.read().count() == 42


def test_a_stream_over_parts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, rows in enumerate(([(1, "a"), (2, "a")], [(2, "b"), (3, "b")])):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({"k": k, "v": v}) for k, v in rows))
        os.utime(tmp_path / "in" / f"{n}.json", (1000 + n, 1000 + n))
    kept = landing.PartedSnapshots(spark, str(tmp_path / "keep"), "k", parts=4)
    stream = landing.landed(spark, str(tmp_path / "in"), "k int, v string", files_per_run=1)
    landing.merged_parts(stream, kept, lambda old, new: old.join(new, "k", "left_anti").unionByName(new), str(tmp_path / "cp")).awaitTermination()
    assert {r["k"]: r["v"] for r in kept.read().collect()} == {1: "a", 2: "b", 3: "b"}
