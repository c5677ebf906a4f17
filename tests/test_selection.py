"""Pilots against the turns as they would be taken one by one; attachments; runs that trip and go on."""

import io
import json
import random
import zipfile
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from pliego.operators import selection as S
from pliego.sources import attachments as A
from pliego.streaming import breaker as B
from pliego.streaming import landing


def direct(records, most_records, most_documents, each):
    """The pilot by taking turns."""
    def turns(tier):
        groups = OrderedDict()
        for r in sorted(tier, key=lambda r: (len(r[4]), r[1] or "", r[2] or "", r[0] or "")):
            groups.setdefault((r[1] or "", r[2] or ""), []).append(r)
        while groups:
            for key in list(groups):
                yield groups[key].pop(0)
                if not groups[key]:
                    del groups[key]

    eligible = [r for r in records if r[4]]
    out, total = [], 0
    for r in [*turns([r for r in eligible if r[3]]), *turns([r for r in eligible if not r[3]])]:
        if len(out) >= most_records or total >= most_documents:
            break
        docs = r[4][:each][: most_documents - total]
        out.append((r[0], docs, "deadline_valid" if r[3] else "strict_temporal_fallback"))
        total += len(docs)
    return out


DDL = "id string, organisme string, ccaa string, valid boolean, documents array<string>"


@pytest.mark.parametrize("caps", [(100, 100, 2), (5, 100, 2), (100, 7, 3), (100, 1, 1), (3, 4, 2)])
def test_pilot_takes_turns(spark, caps):
    r = random.Random(str(caps))
    records = [(f"r{k:03}", r.choice(["a", "a", "a", "b", None, "c"]), r.choice(["X", "Y", None]), r.choice([True, False, None]), [f"d{k}.{j}" for j in range(r.randint(0, 4))] or None) for k in range(60)]
    got = S.pilot(spark.createDataFrame(records, DDL).repartition(3), "documents", F.col("valid"), *caps).orderBy("place").collect()
    assert [(x["id"], x["documents"], x["selection_tier"]) for x in got] == direct(records, *caps)
    assert S.pilot(spark.createDataFrame([], DDL), "documents", F.col("valid"), *caps).count() == 0


def docx(*paragraphs, name=A._DOCX):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t><w:tab/><w:t>x</w:t></w:r><w:br/></w:p>" if p else "<w:p/>" for p in paragraphs)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr(name, f'<w:document xmlns:w="{A._W[1:-1]}"><w:body>{body}</w:body></w:document>')
        z.writestr("other.bin", b"123")
    return buffer.getvalue()


GOOD = docx("Objeto", "", "Lotes")
FILES = {
    "docx": (GOOD, None, "docx", "extracted", "Objeto\tx\nLotes\tx"), "cut": (GOOD[:60], None, "unknown", "unsupported_type", None), "zip": (docx("a", name="a.xml"), None, "zip_other", "unsupported_type", None),
    "broken": (docx("<w:t"), None, "docx", "parse_failed", None), "blank": (docx(""), None, "docx", "text_empty", None), "pdf": (b"%PDF-1.7 x", "text/plain", "pdf", "unsupported_type", None),
    "html": (b"  <!DOCTYPE html><p>x", None, "html", "unsupported_type", None), "xml": (b"<?xml version='1.0'?><a/>", None, "xml", "extracted", "<?xml version='1.0'?><a/>"), "text": (b"plain words", None, "text", "extracted", "plain words"),
    "told": (b"\x01\x02\x03", "text/plain; charset=x", "text", "extracted", "\x01\x02\x03"), "odd": (b"\x01\x02\x03", None, "unknown", "unsupported_type", None), "none": (None, None, "unknown", "text_empty", None), "empty": (b"", "text/html", "html", "text_empty", None),
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(n, bytearray(b) if b is not None else None, t, 7) for n, (b, t, *_) in FILES.items()], "path string, content binary, told string, extra int")


def test_attachments_are_read_or_say_why_not(files):
    got = {r["path"]: r for r in A.attachment_texts(files, declared=F.col("told")).collect()}
    assert {n: (r["detected_type"], r["extraction_status"], r["text"]) for n, r in got.items()} == {n: f[2:] for n, f in FILES.items()}
    assert all((r["reason"] is None) == (r["extraction_status"] == "extracted") and r["extra"] == 7 and len(r["sha256"]) == 64 for r in got.values())


def test_archive_members(files):
    got = {(r["path"], r["name"]): (r["size"], r["reason"]) for r in A.archive_members(files.where("path in ('docx', 'zip', 'cut', 'none')"), "path").collect()}
    assert got["docx", "other.bin"] == (3, None) and ("zip", "a.xml") in got and got["cut", None][1] and got["none", None][1]


def test_texts_by_digest_then_by_place(spark, files, tmp_path):
    texts = A.attachment_texts(files).cache()
    digest = texts.where("path = 'docx'").first()["sha256"]
    docs = spark.createDataFrame([(1, digest, "nowhere"), (2, "0" * 64, "text"), (3, None, "pdf"), (4, None, None)], "i int, doc_sha256 string, place string")
    got = {r["i"]: r["text"] for r in A.with_texts(docs, texts.unionByName(texts), location="place").collect()}
    assert got == {1: "Objeto\tx\nLotes\tx", 2: "plain words", 3: None, 4: None}
    assert {r["i"]: r["text"] for r in A.with_texts(docs, texts).collect()}[2] is None
    (tmp_path / "a.txt").write_bytes(b"x y")
    assert A.attachment_texts(A.read_attachments(spark, str(tmp_path))).first()["text"] == "x y"


def land(folder, number, statuses, start):
    with open(folder / f"{number}.json", "w") as f:
        for k, s in enumerate(statuses):
            f.write(json.dumps({"id": start + k, "pos": start + k, "outcome": s}) + "\n")


def run(spark, tmp_path, attempts):
    stream = landing.landed(spark, str(tmp_path / "in"), "id long, pos long, outcome string", files_per_run=1)
    query = B.guarded_run(stream, attempts, str(tmp_path / "checkpoint"))
    try:
        query.awaitTermination()
    except Exception as e:
        return str(e)
    return None


def attempts_of(spark, tmp_path, **limits):
    tried = []
    def attempt(rows):
        tried.append(sorted(r["id"] for r in rows.collect()))
        return rows.withColumnRenamed("outcome", "status")

    return B.Attempts(spark, str(tmp_path / "out"), attempt, "id", "pos", **limits), tried


def test_a_run_that_trips_goes_on_when_resumed(spark, tmp_path):
    import os
    import time

    (tmp_path / "in").mkdir()
    for number, statuses in enumerate((["resolved"] * 4, ["resolved", "error", "error"], ["error", "resolved"], ["resolved", "unresolved"])):
        land(tmp_path / "in", number, statuses, 10 * number)
        os.utime(tmp_path / "in" / f"{number}.json", (time.time() - 100 + number,) * 2)
    attempts, tried = attempts_of(spark, tmp_path, most_in_a_row=3, most_share=0.9)
    assert "consecutive_errors=3 >= threshold=3" in run(spark, tmp_path, attempts)
    assert attempts.state()[2:5] == (9, 3, 0) and attempts.results().count() == 9 and len(tried) == 3
    assert "consecutive_errors=3" in run(spark, tmp_path, attempts) and len(tried) == 3
    assert attempts.resume().run == 1
    assert run(spark, tmp_path, attempts) is None
    assert attempts.results().count() == 11 and attempts.state().reason is None and sorted(r["id"] for r in attempts.results().select("id").collect()) == [0, 1, 2, 3, 10, 11, 12, 20, 21, 30, 31]
    land(tmp_path / "in", 9, ["resolved"], 31)
    assert run(spark, tmp_path, attempts) is None and tried[-1] == [] and attempts.results().count() == 11


def test_a_high_share_of_errors_trips(spark, tmp_path):
    (tmp_path / "in").mkdir()
    land(tmp_path / "in", 0, ["resolved", "skipped", "resolved", "skipped"], 0)
    attempts, _ = attempts_of(spark, tmp_path, most_share=0.4)
    assert "error_rate=0.5000 > threshold=0.4" in run(spark, tmp_path, attempts)


@pytest.mark.parametrize(("streak", "statuses", "want"), [(0, [], (0, 0, 0, 0)), (2, [], (0, 0, 2, 2)), (2, ["error"], (1, 1, 3, 3)), (2, ["resolved"], (1, 0, 2, 0)), (1, ["error", "error", "resolved", "error"], (4, 3, 3, 1)), (0, ["skipped", "error", "resolved", "error", "error"], (5, 4, 2, 2)), (5, ["skipped"], (1, 1, 5, 0))])
def test_errors_in_a_row_go_on_over_batches(spark, tmp_path, streak, statuses, want):
    attempts, _ = attempts_of(spark, tmp_path)
    rows = spark.createDataFrame([(k, k, s) for k, s in enumerate(statuses)], "id int, pos int, status string")
    assert attempts._counted(rows, B.State(streak=streak)) == want
