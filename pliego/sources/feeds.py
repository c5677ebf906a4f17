"""Notice feeds: Atom entries with contract data, from files, folders and zip archives.

A file is tested by an XML parser and cut into entries by a regular expression; each entry
is parsed once for its fields, and once for its nested lists, which come from one walk over its elements.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.notices import mapped
from ..functions.semantics import budget_range, plain_number
from ..functions.tables import NOTICE_TYPE_BY_CODE, STATUS_BY_CODE


def read_entry_texts(spark: SparkSession, path: str, pattern: str = "*.atom", limit: int | None = None) -> DataFrame:
    """(file, position, entry): the text of each entry below a folder; malformed files give none.

    ``limit`` takes the first files by name. Positions count entries in a file from 0.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select(F.col("path").alias("file"), F.col("content").cast("string").alias("xml"))
    if limit is not None:
        files = files.orderBy("file").limit(limit)
    return entries(files)


_PREFIX, _DECLARED, _ENTRY = re.compile(r"(</?)[A-Za-z_][\w.-]*:", re.A), re.compile(r"\sxmlns(?::\w+)?=\"[^\"]*\"", re.A), re.compile(r"<entry[\s>].*?</entry>", re.A | re.S)


def _bare(xml: str) -> str:
    """A document without the prefixes and declarations of its name spaces."""
    return _DECLARED.sub("", _PREFIX.sub(r"\1", xml))


def _whole(bare: str) -> bool:
    """Whether a bare text is a whole XML document; prefixes of attributes may have lost their declarations."""
    try:
        expat.ParserCreate("utf-8").Parse(bare.encode("utf-8", "surrogatepass"), True)
    except expat.ExpatError:
        return False
    return True


def malformed(files: DataFrame) -> DataFrame:
    """(file): the files of (file, xml) that are no XML; entries() leaves them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odd = [xml is None or not _whole(_bare(xml)) for xml in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(odd, pa.bool_()))], ["file"])

    return files.select("file", "xml").mapInArrow(run, f"file {files.schema['file'].dataType.simpleString()}")


def entries(files: DataFrame) -> DataFrame:
    """(file, position, entry) of (file, xml); files that are no XML give none. Each file is stripped, tested and cut once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, out = [], [], []
            for i, xml in enumerate(batch.column(1).to_pylist()):
                bare = _bare(xml or "")
                found = _ENTRY.findall(bare) if _whole(bare) else []
                row += [i] * len(found)
                at += range(len(found))
                out += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(at, pa.int32()), pa.array(out, pa.string())], ["file", "position", "entry"])

    return files.select("file", "xml").mapInArrow(run, f"file {files.schema['file'].dataType.simpleString()}, position int, entry string")


def read_archives(spark: SparkSession, path: str, member: str = ".atom") -> DataFrame:
    """(file, xml, reason): the members of zip archives below a folder, named archive!member.

    A member that cannot be read has a null xml and a reason; an archive that is none has one
    row of that kind under its own name. The other members stay.
    """
    archives = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                for row in _members(name, content, member):
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in row], ["file", "xml", "reason"])

    return archives.mapInArrow(run, "file string, xml string, reason string")


#: What reading a damaged, encrypted or oddly packed member of an archive raises.
_DAMAGE = (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError, OSError)


def _members(name: str, content: bytes, member: str) -> Iterator[tuple[str, str | None, str | None]]:
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except _DAMAGE as e:
        yield name, None, f"{type(e).__name__}: {e}"
        return
    with archive:
        for m in sorted(m for m in archive.namelist() if m.endswith(member)):
            try:
                yield f"{name}!{m}", archive.read(m).decode("utf-8", "replace"), None
            except _DAMAGE as e:
                yield f"{name}!{m}", None, f"{type(e).__name__}: {e}"


_STATUS = "ContractFolderStatus"
#: The elements of an entry that hold a field, by path below the entry; the first with a text counts.
_PATHS = {
    "winner": [f"{_STATUS}/{p}WinningParty/PartyName/Name" for p in ("", "TenderResult/", "AwardedTenderedProject/")],
    "body": [f"{_STATUS}/{p}/Name" for p in ("LocatedContractingParty/Party/PartyName", "LocatedContractingParty/PartyName", "ContractingParty/Party/PartyName", "ContractingParty/PartyName")],
    "day": [f"{_STATUS}/{p}EndDate" for p in ("TenderSubmissionDeadlinePeriod/", "TenderingProcess/TenderSubmissionDeadlinePeriod/", "")],
    "id": ["id"], "title": ["title"], "updated": ["updated"],
}
_AMOUNTS = [f"{_STATUS}/{p}" for p in ("BudgetAmount/TaxExclusiveAmount", "BudgetAmount/TaxInclusiveAmount", "EstimatedOverallContractAmount", "LineExtensionAmount", "TaxableAmount")]
_CODES = ("ItemClassificationCode", "ClassificationCode", "CommodityCode")
_READ = {
    **dict.fromkeys(_PATHS, "string"), "link": "string", "folder_id": "string", "code": "string", "awarded": "boolean", "amounts": "array<string>", "codes": "array<string>", "documents": "array<string>",
}
_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _said(element) -> str:
    return "" if element is None else "".join(element.itertext()).strip(" ")


def _read_entry(text: str) -> dict:
    """What ``parsed`` needs of an entry, from one parse."""
    root = _tree(text)
    first = lambda name: _said(next(root.iter(name), None))
    links = [e.get("href", "") for e in root.findall("link[@rel='alternate']")][:1] + [e.get("href", "") for e in root.findall("link")][:1]
    found = {name: next((t for p in paths if (t := _said(root.find(p)))), "") for name, paths in _PATHS.items()}
    return found | {
        "link": next(filter(None, links), ""), "folder_id": first("ContractFolderID"), "code": first("ContractFolderStatusCode"), "amounts": [_said(root.find(p)) for p in _AMOUNTS],
        "awarded": any(r.find(f".//{tag}") is not None for r in root.iter("TenderResult") for tag in ("WinningParty", "AwardedTenderedProject")),
        "codes": [e.text for e in root.iter() if e.tag in _CODES and e.text], "documents": [e.text for d in root.iter("DocumentReference") for e in d.findall("Attachment/ExternalReference/URI") if e.text],
    }


def parsed(rows: DataFrame) -> DataFrame:
    """entries with id, title, link, updated, folder_id, status_code, status, organisation, budget, deadline, winner, cpv, documents.

    Each entry is parsed once; one that is no XML has nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in _READ}
            for text in batch.column("entry").to_pylist():
                try:
                    found = _read_entry(text)
                except ElementTree.ParseError:
                    found = {}
                for n, x in out.items():
                    x.append(found.get(n))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("position"), *(pa.array(x, _ARROW[_READ[n]]) for n, x in out.items())], ["file", "position", *out])

    read = rows.select("file", "position", "entry").mapInArrow(run, f"file string, position int, {', '.join(f'{n} {t}' for n, t in _READ.items())}")
    code, body, winner = F.upper("code"), F.col("body"), F.col("winner")
    return read.select(
        "file", "position", "id", "title", "link", "updated", "folder_id", code.alias("status_code"),
        F.coalesce(mapped(STATUS_BY_CODE, code), F.when(F.col("awarded"), "Adjudicado"), F.lit("")).alias("status"), F.when(F.length(body) >= 4, F.left(body, F.lit(150))).otherwise("").alias("organisation"),
        F.array_max(F.transform("amounts", lambda a: budget_range(plain_number(a)))).alias("budget"), F.regexp_extract("day", r"(\d{4}-\d{2}-\d{2})", 1).alias("deadline"),
        F.when((F.length(winner) >= 3) & ~winner.rlike(r"(?i)^ES[\s\-]?\d"), F.left(winner, F.lit(120))).otherwise("").alias("winner"),
        F.array_distinct(F.filter(F.transform("codes", lambda c: F.trim(c)), lambda c: c.rlike(r"^[1-9]\d{7}$"))).alias("cpv"), "documents",
    )


# Element names, without prefix and in lower case, and what they say.
DOCUMENT_TAGS = (
    "legaldocumentreference", "technicaldocumentreference", "additionalpublicationdocumentreference", "templatedocumentreference",
    "attachmentdocumentreference", "documentreference", "additionalattachment",
)
MIME_BY_EXTENSION = {
    "pdf": "application/pdf", "zip": "application/zip", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
FORMALIZATION_TAGS = ("formalizationdate", "signingdate", "contractdate")
_NIF, _REGION, _ISO = re.compile(r"[A-Z][0-9A-Z]{7,8}"), re.compile(r"ES[\s\-]?\d", re.I), re.compile(r"\d{4}-\d{2}-\d{2}")

AWARDS = (
    "array<struct<notice_id:string,notice_type:string,result_code:string,winning_party_name:string,winning_party_nif:string,award_amount_tax_excl:double,award_amount_tax_incl:double,"
    "lot_id:string,lot_title:string,contract_id:string,award_date:string,formalization_date:string,modification_date:string,provenance:string>>"
)
DOCUMENTS = "array<struct<notice_id:string,notice_type:string,document_type:string,source_section:string,title:string,url:string,mime_hint:string,format_hint:string,published_at:string,provenance:string>>"


_PREFIXED = re.compile(r"(\s)[A-Za-z_][\w.-]*:([A-Za-z_][\w.-]*\s*=)")


def _tree(text: str):
    """The elements of an entry. Its declarations are gone, so prefixes of attributes are taken off where they keep it from being read."""
    try:
        return ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return ElementTree.fromstring(re.sub("<[^<>]*>", lambda tag: _PREFIXED.sub(r"\1\2", tag.group()), text))


def _walked(text: str) -> tuple[list[tuple[str, str]], list[int]]:
    """(local name in lower case, trimmed text) of each element in document order, and the end of the range of those at and below it."""
    root = _tree(text)
    elements = [e for e in root.iter() if isinstance(e.tag, str)]
    sizes: dict[int, int] = {}
    for e in reversed(elements):
        sizes[id(e)] = 1 + sum(sizes.get(id(child), 0) for child in e)
    return [(e.tag.rpartition("}")[2].lower(), (e.text or "").strip()) for e in elements], [i + sizes[id(e)] for i, e in enumerate(elements)]


def _first_text(found: list[tuple[str, str]], names: tuple[str, ...], fits=bool) -> str | None:
    return next((v for n, v in found if n in names and fits(v)), None)


def _amount(text: str) -> float | None:
    try:
        return float(text.replace(",", "."))
    except ValueError:
        return None


def _formalized(found: list[tuple[str, str]], code: str, issued: str) -> str:
    value = _first_text(found, FORMALIZATION_TAGS)
    if value:
        date = _ISO.search(value)
        return date.group() if date else value[:10]
    return issued[:10] if code == "FOR" else ""


def _award(found: list[tuple[str, str]], notice: tuple[str, str], formalized: str) -> dict:
    amount = lambda tag: next((a for n, v in found if n == tag and (a := _amount(v)) is not None), None)
    return {
        "notice_id": notice[0], "notice_type": notice[1], "result_code": _first_text(found, ("resultcode",)) or "",
        "winning_party_name": (_first_text(found, ("partyname", "name"), lambda v: len(v) >= 3 and not _REGION.match(v)) or "")[:120],
        "winning_party_nif": _first_text(found, ("companyid",), _NIF.match) or "", "award_amount_tax_excl": amount("taxexclusiveamount"), "award_amount_tax_incl": amount("payableamount"),
        "lot_id": next((v for n, v in found if n == "lotid"), None), "lot_title": None, "contract_id": next((v for n, v in found if n == "contractid"), None),
        "award_date": (_first_text(found, ("awarddate",)) or "")[:10], "formalization_date": formalized, "modification_date": "", "provenance": "feed_xml",
    }


def _document(found: list[tuple[str, str]], notice: tuple[str, str]) -> dict:
    url = (_first_text(found, ("uri", "url")) or "")[:500]
    extension = url.rsplit(".", 1)[-1].lower().split("?")[0][:8] if url else ""
    return {
        "notice_id": notice[0], "notice_type": notice[1], "document_type": _first_text(found, ("documenttypecode",)) or "", "source_section": found[0][0],
        "title": (_first_text(found, ("filename", "title", "documentdescription", "name")) or "")[:200], "url": url, "mime_hint": MIME_BY_EXTENSION.get(extension, ""),
        "format_hint": extension.upper(), "published_at": (_first_text(found, ("issuedate",)) or "")[:10], "provenance": "feed_xml",
    }


def details(rows: DataFrame, issued: str | None = None) -> DataFrame:
    """(file, position, folder_id, notice_type_code, notice_type, related_contract_ids, winning_party_nif,
    formalization_date, award_results, documents, reason) of entries: elements at any depth, by local name.

    One walk numbers the elements of an entry; what lies below an element is then a range. An
    entry that is no XML has nulls and a reason.

    Each TenderResult gives an award and each document element a document, nested ones too;
    a field is its first value that fits. An amended contract counts before the status code.
    ``issued`` names a column with the issue date, which stands in for the date of a
    formalization.
    """
    types = [pa.string()] * 3 + [pa.list_(pa.string())] + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for text, issue in zip(batch.column("entry").to_pylist(), batch.column("issued").to_pylist()):
                try:
                    found, ends = _walked(text)
                except ElementTree.ParseError as e:
                    for x, v in zip(out, (*[None] * 8, str(e))):
                        x.append(v)
                    continue
                code = (_first_text(found, ("contractfolderstatuscode",)) or "").upper()
                kind = "CONTRACT_MODIFICATION" if any(n == "contractmodification" for n, _ in found) else NOTICE_TYPE_BY_CODE.get(code, "UNKNOWN")
                notice, formalized = (next((v for n, v in found if n == "id"), ""), kind), _formalized(found, code, issue or "")
                under = lambda *names: [found[i : ends[i]] for i, (n, _) in enumerate(found) if n in names]
                nif = next((v for p in under("winningparty") for n, v in p if n == "companyid" and _NIF.match(v)), "")
                row = (
                    next((v for n, v in found if n == "contractfolderid"), ""), next((v for n, v in found if n == "noticetypecode"), ""), kind,
                    list(dict.fromkeys(v for n, v in found if n in ("contractid", "contractidentifier") and v)), nif, formalized,
                    [_award(x, notice, formalized) for x in under("tenderresult")], [_document(x, notice) for x in under(*DOCUMENT_TAGS)], None,
                )
                for x, v in zip(out, row):
                    x.append(v)
            kinds = [*types, pa.list_(_AWARD_TYPE), pa.list_(_DOCUMENT_TYPE), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("position"), *(pa.array(x, t) for x, t in zip(out, kinds))], _DETAILS)

    given = rows.select("file", "position", "entry", (F.col(issued) if issued else F.lit(None)).cast("string").alias("issued"))
    return given.mapInArrow(run, f"file string, position int, folder_id string, notice_type_code string, notice_type string, related_contract_ids array<string>, winning_party_nif string, formalization_date string, award_results {AWARDS}, documents {DOCUMENTS}, reason string")


def _struct_type(kind: str) -> pa.DataType:
    inner = kind.removeprefix("array<struct<").removesuffix(">>")
    return pa.struct([(n, pa.float64() if t == "double" else pa.string()) for n, t in (f.split(":") for f in inner.split(","))])


_AWARD_TYPE, _DOCUMENT_TYPE = _struct_type(AWARDS), _struct_type(DOCUMENTS)
_DETAILS = ["file", "position", "folder_id", "notice_type_code", "notice_type", "related_contract_ids", "winning_party_nif", "formalization_date", "award_results", "documents", "reason"]
