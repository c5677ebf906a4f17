"""Attached files: what they are by their bytes, the members of archives, the text of those that can be read here.

Bytes are looked at in Arrow batches of a binary column. A file that is damaged, empty or of
a kind that is not read (PDF among them) gives a row with a state and a reason, never an error.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The name space of word processing, and the member that makes a zip archive a DOCX file.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DOCX = "word/document.xml"
_DAMAGE = (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError, OSError, KeyError, ValueError)


def members(content: bytes) -> list[tuple[str, int]]:
    """(name, size) of the members of a zip archive; raises one of the errors of damage."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        return [(i.filename, i.file_size) for i in archive.infolist()]


def kind_of(content: bytes | None, declared: str | None = None) -> str:
    """pdf, docx, zip_other, html, xml, text or unknown: by the first bytes, then the declared type, then the share of printable bytes."""
    content, declared = content or b"", (declared or "").lower()
    if content.startswith(b"%PDF"):
        return "pdf"
    if content.startswith(b"PK"):
        try:
            return "docx" if any(name == _DOCX for name, _ in members(content)) else "zip_other"
        except _DAMAGE:
            return "unknown"
    lead = content[:512].lstrip().lower()
    if lead.startswith((b"<!doctype html", b"<html")) or "text/html" in declared:
        return "html"
    if lead.startswith(b"<?xml") or "xml" in declared:
        return "xml"
    if "text/plain" in declared:
        return "text"
    sample = content[:1024]
    printable = sum(9 <= b <= 13 or 32 <= b <= 126 or b >= 160 for b in sample)
    return "text" if sample and printable / len(sample) > 0.9 else "unknown"


def docx_text(content: bytes) -> str:
    """The paragraphs of a DOCX file that are not blank, one a line; raises an error of damage or of XML."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = ElementTree.fromstring(archive.read(_DOCX))
    lines = []
    for paragraph in root.iter(f"{_W}p"):
        runs = []
        for node in paragraph.iter():
            if node.tag == f"{_W}t":
                runs.append(node.text or "")
            elif node.tag == f"{_W}tab":
                runs.append("\t")
            elif node.tag in (f"{_W}br", f"{_W}cr"):
                runs.append("\n")
        if line := "".join(runs).strip():
            lines.append(line)
    return "\n".join(lines).strip()


def read(content: bytes | None, declared: str | None) -> tuple[str, str, str | None, str | None]:
    """(kind, state, text, reason): extracted, text_empty, unsupported_type or parse_failed."""
    kind = kind_of(content, declared)
    if not content:
        return kind, "text_empty", None, "no bytes"
    if kind == "docx":
        try:
            text = docx_text(content)
        except (*_DAMAGE, ElementTree.ParseError) as e:
            return kind, "parse_failed", None, f"{type(e).__name__}: {e}"
    elif kind in ("text", "xml"):
        text = content.decode("utf-8", "replace").strip()
    else:
        return kind, "unsupported_type", None, f"{kind} is not read"
    return (kind, "extracted", text, None) if text else (kind, "text_empty", None, "no text")


def read_attachments(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")


def attachment_texts(files: DataFrame, content: str = "content", declared: Column | None = None) -> DataFrame:
    """files with sha256, detected_type, extraction_status, chars, text and reason instead of the bytes; other columns stay."""
    rest = [c for c in files.columns if c != content]
    kind = F.lit(None).cast("string") if declared is None else declared
    rows = files.select(*(F.col(f"`{c}`") for c in rest), F.col(content).alias("_bytes"), kind.alias("_declared"))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in files.schema if f.name != content)}{', ' if rest else ''}sha256 string, detected_type string, extraction_status string, chars int, text string, reason string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for value, told in zip(batch.column("_bytes"), batch.column("_declared").to_pylist()):
                data = value.as_py()
                kind, state, text, reason = read(data, told)
                for x, v in zip(out, (hashlib.sha256(data or b"").hexdigest(), kind, state, len(text or ""), text, reason)):
                    x.append(v)
            types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
            names = [*rest, "sha256", "detected_type", "extraction_status", "chars", "text", "reason"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *(pa.array(x, t) for x, t in zip(out, types))], names)

    return rows.mapInArrow(run, schema)


def archive_members(files: DataFrame, ident: str, content: str = "content") -> DataFrame:
    """(ident, name, size, reason): the members of each zip archive, or one row without a name and with the reason why there are none."""
    kind = files.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], [[], [], []]
            for i, value in enumerate(batch.column("_bytes")):
                try:
                    found = [(n, s, None) for n, s in members(value.as_py() or b"")] or [(None, None, "empty archive")]
                except _DAMAGE as e:
                    found = [(None, None, f"{type(e).__name__}: {e}")]
                for f in found:
                    row.append(i)
                    for x, v in zip(out, f):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(ident).take(pa.array(row, pa.int64())), *(pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.string())))], [ident, "name", "size", "reason"])

    return files.select(ident, F.col(content).alias("_bytes")).mapInArrow(run, f"`{ident}` {kind}, name string, size long, reason string")


def with_texts(documents: DataFrame, texts: DataFrame, digest: str = "doc_sha256", location: str | None = None) -> DataFrame:
    """documents with ``text``, that of their digest, else of the file at ``location``; null if there is neither.

    texts (sha256, text, path): each digest and path counts once, so documents keep their number.
    """
    by_digest = texts.where("text IS NOT NULL").groupBy(F.col("sha256").alias(digest)).agg(F.min("text").alias("_by_digest"))
    out = documents.join(by_digest, digest, "left")
    if location is None:
        return out.withColumnRenamed("_by_digest", "text")
    by_path = texts.where("text IS NOT NULL").groupBy(F.col("path").alias(location)).agg(F.min("text").alias("_by_path"))
    return out.join(by_path, location, "left").withColumn("text", F.coalesce("_by_digest", "_by_path")).drop("_by_digest", "_by_path").select(*documents.columns, "text")
