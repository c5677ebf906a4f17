"""Exports, manifests of written files, guarded paths, editions and their juries."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pliego.operators import editions as D
from pliego.operators.partition import write_shards
from pliego.sources import exports as X


def test_export_is_the_file_in_name_order(spark, tmp_path):
    rows = spark.createDataFrame([('a "b"', 12345678.25, ["x", None], 2), (None, 3.0, None, 1), ("two\nlines", None, [], 3)], "t string, n double, l array<string>, k int")
    X.write_export(rows, str(tmp_path / "e"), [F.col("k").desc()], ("t", "n", "l"))
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "e").glob("part-*")))
    assert text == '\ufefft;n;l\n"two\nlines";"";""\n"a ""b""";"12345678.25";"x,"\n"";"3";""\n'


def test_export_numbers_and_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([(v,) for v in (0.1, -0.5, 1e20, 1000000.0, 100.5)], "n double")
    lines = [r["line"] for r in X.export_lines(rows, ("n",)).collect()]
    assert lines == ['"0.1"', '"-0.5"', '"1.0E20"', '"1000000"', '"100.5"']
    X.write_export(rows.limit(0), str(tmp_path / "e"), [F.col("n")], ("n",))
    assert "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "e").glob("part-*")) == "\ufeffn\n"


def test_manifest_sees_changed_missing_and_new_files(spark, tmp_path):
    path = tmp_path / "t"
    write_shards(spark.range(30).withColumn("year", F.col("id") % 3).repartition(1), "year", str(path))
    kept = [tuple(r) for r in X.file_manifest(spark, str(path), "year").collect()]
    before = spark.createDataFrame(kept, "shard string, file string, bytes long, sha256 string")
    assert {r["shard"]: r["files"] for r in X.shard_sizes(before).collect()} == {"0": 1, "1": 1, "2": 1}
    files = {s: next((path / f"year={s}").glob("part-*")) for s in "012"}
    assert {r["bytes"] for r in before.where("shard = '0'").collect()} == {files["0"].stat().st_size}
    for crc in path.rglob(".*.crc"):
        crc.unlink()  # else the local file system itself refuses the changed file
    files["0"].write_bytes(b"other")
    files["1"].unlink()
    Path(path / "year=2" / "part-new").write_bytes(b"x")
    found = X.verified_files(X.file_manifest(spark, str(path), "year"), before)
    assert sorted((r["shard"], r["state"]) for r in found.collect()) == [("0", "changed"), ("1", "missing"), ("2", "ok"), ("2", "unlisted")]


def test_guarded_paths(spark, tmp_path):
    assert X.safe_output("out/a", "/r", ["out"]) == "out/a"
    assert X.safe_output("/r/out", "/r", ["out"]) == "out"
    assert X.safe_output("s3://b/r/out/a", "s3://b/r", ["out"]) == "out/a"
    for bad in ("../x", "/etc/out", "outer/a", "out/../data", "s3://other/r/out", "out/kept"):
        with pytest.raises(ValueError):
            X.safe_output(bad, "/r", ["out"], ["out/kept"])
    with pytest.raises(ValueError):
        X.write_reports({"ok": spark.range(1), "../../bad": spark.range(1)}, str(tmp_path), "reports")
    assert not list(tmp_path.iterdir())
    X.write_reports({"conflicts": spark.range(2)}, str(tmp_path), "reports")
    assert spark.read.json(str(tmp_path / "reports" / "conflicts")).count() == 2


def test_editions(spark):
    rows = [(2023, 1, "", None, None, None, None, None), (2024, 2, "First", "note", None, 0, None, None), (2024, 3, "Second", "", 1, 1, 1, 1), (None, 4, "x", "", 1, 1, 1, 1)]
    editions = spark.createDataFrame(rows, "year int, pos int, edition_label string, status_note string, participants int, nationalities int, awards_count int, attendees_nit_laus int")
    years = spark.createDataFrame([(2024,), (2024,), (2022,), (None,)], "year int")
    found = D.edition_summary(editions, years, years.limit(0), "Awards").select("year", "title", "has_stats", "categories", "jurors").collect()
    assert [tuple(r) for r in found] == [(2024, "First", True, 2, 0), (2023, "Awards 2023", False, 0, 0)]
    assert [r[0] for r in D.edition_years(editions).collect()] == [2024, 2023]


def test_juries(spark):
    rows = [(2024, 1, "Ana", "Head", None, "B", True), (2024, 2, "Bo", None, "Ana & Co", "", None), (2024, 3, None, "x", "y", "B", False), (None, 4, "ANA", None, None, None, None)]
    juries = spark.createDataFrame(rows, "year int, pos int, name string, role string, studio_or_context string, category_judged string, is_chair boolean")
    assert sorted(r["pos"] for r in D.jurors_found(juries, " aNa ").collect()) == [1, 2, 4]
    assert D.jurors_found(juries, " ").count() == 4
    groups = {r["pos"]: (r["category"], r["group_pos"], r["chair"]) for r in D.jury_groups(juries).collect()}
    assert groups == {1: ("B", 1, True), 2: (D.NO_CATEGORY, 2, False), 3: ("B", 1, False), 4: (D.NO_CATEGORY, 4, False)}


def test_one_document_of_many_parts(spark, tmp_path):
    import json

    from pliego.sources.json_files import write_document

    for n in (0, 1, 500):
        rows = spark.range(n).selectExpr("id", "concat('ñ\"', id) AS t", "CASE WHEN id % 2 = 0 THEN id END AS v").repartition(5)
        write_document(rows, str(tmp_path / str(n)), {"schema": "x/1"}, "id")
        text = "".join(p.read_text() for p in sorted((tmp_path / str(n)).glob("part-*")))
        found = json.loads(text)
        assert found["meta"] == {"schema": "x/1", "records": n} and found["data"] == [{"id": i, "t": f'ñ"{i}', "v": i if i % 2 == 0 else None} for i in range(n)]
