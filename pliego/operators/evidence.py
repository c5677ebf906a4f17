"""Document evidence: candidate links, their kind and confidence, resolution and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import ratio, truthy
from .dedup import best_of, top_n

# Words that make a link a document candidate, and the rules that name its kind.
DOCUMENT_WORDS = (
    "pliego", "plec", "prescripciones", "prescripcions", "cláusulas", "clausulas", "clausules", "pcap", "ppt", "documento", "document",
    "expediente", "anexo", "annex", "anexos", "annexos", "adjudica", "formalizaci", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip",
    "getdocumentbyidservlet", "docacccmpnt", "descargar", "download",
)
KIND_RULES = (
    (("pliego de prescripciones", "prescripciones tecnicas", "pliego tecnico", "plec de prescripcions", "plec prescripcions tecniques"), "pliego_tecnico"),
    (("pliego de clausulas", "clausulas administrativas", "pliego administrativo", "plec de clausules administratives", "plec clausules administratives", "pcap"), "pliego_admin"),
    (("prescripciones", "prescripcions", "ppt"), "pliego_tecnico"),
    (("clausulas", "clausules", "cláusulas", "pca"), "pliego_admin"),
    (("pliego", "plec"), "pliego_admin"),
    (("anexo", "annex", "anexos", "annexos"), "annex"),
    (("adjudicaci", "adjudicatario", "formalizaci", "acta adjudica"), "award_doc"),
    (("getdocumentbyidservlet", "docacccmpnt"), "generic_doc"),
    (("documento", "document", "descargar", "download", "expediente", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip"), "generic_doc"),
)
STRONG = ("pcap", "ppt", "pliego", "plec", "prescripciones", "prescripcions", "clausulas", "clausules", "cláusulas", "anexo", "annex", "adjudicaci", "formalizaci")
WHOLE_WORDS = ("pca", "pcap", "ppt", "pptx")
EXTENSIONS = ("pdf", "docx", "doc", "xlsx", "xls", "zip", "odt", "ods")
FAMILY_PARAMETERS = ("docId", "docid", "id", "iddocument", "nodeId", "nodeid", "idDocument", "documentId", "fileId", "fileid")
CONFIDENCE = {"low": 0, "medium": 1, "high": 2}


def _any(text: Column, tokens: tuple[str, ...]) -> Column:
    """Short acronyms match as whole words, other tokens anywhere."""
    parts = [rf"\b{t}\b" if t in WHOLE_WORDS else rf"\Q{t}\E" for t in tokens]
    return text.rlike("(?U)" + "|".join(parts))


def is_candidate(href: Column, text: Column) -> Column:
    both = F.concat_ws(" ", F.lower(href), F.lower(text))
    return both.rlike("|".join(rf"\Q{w}\E" for w in DOCUMENT_WORDS))


def kind(href: Column, text: Column) -> Column:
    both = F.lower(F.concat_ws("\n", text, href))  # no token spans the break
    out = None
    for tokens, name in KIND_RULES:
        hit = _any(both, tokens)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def confidence(href: Column, text: Column) -> Column:
    h, t = F.lower(href), F.lower(text)
    has_text = F.trim(t) != ""
    extension = h.contains(".pdf") | h.contains(".docx") | h.contains(".doc")
    return F.when(_any(t, STRONG) | (extension & has_text), "high").when(has_text, "medium").otherwise("low")


def extension(url: Column) -> Column:
    path = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1))
    found = F.regexp_extract(path, r"\.(" + "|".join(EXTENSIONS) + r")$", 1)
    gateway = F.lower(url).rlike("getdocumentbyidservlet|docacccmpnt")
    return F.when(found != "", found).when(gateway, "gateway").otherwise("")


def normal_url(url: Column) -> Column:
    """Lower-case scheme and host, no fragment."""
    head = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?", 0)
    return F.concat(F.lower(head), F.regexp_replace(F.substr(url, F.length(head) + 1), r"#.*$", ""))


def family(url: Column) -> Column:
    """What the format variants of one document share: host with its id parameter, else its path."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    found = [F.nullif(F.regexp_extract(url, rf"[?&]{p}=([^&#]+)", 1), F.lit("")) for p in FAMILY_PARAMETERS]
    named = F.coalesce(*(F.concat(F.lit(f"{p.lower()}="), v) for p, v in zip(FAMILY_PARAMETERS, found)))
    path = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)), r"\.[^./]*$", "")
    return F.when(named.isNotNull(), F.concat(host, F.lit("|"), named)).when(~path.isin("", "/"), F.concat(host, F.lit("|"), path))


def described(links: DataFrame, page_url: str | None = None) -> DataFrame:
    """links (href, text, ...) with kind, confidence, extension, url and family; only candidates.

    ``page_url`` names the column with the address of a link's page, against which href is resolved first.
    """
    rows = links.where(is_candidate(F.col("href"), F.col("text")))
    rows = rows.withColumn("href", absolute_url(F.col(page_url), F.col("href"))) if page_url else rows
    return rows.withColumns({
        "kind": kind(F.col("href"), F.col("text")), "confidence": confidence(F.col("href"), F.col("text")), "extension": extension(F.col("href")),
        "url": normal_url(F.col("href")), "family": family(F.col("href")),
    })


#: Titles of links that lead about a site, in lower case.
NAVIGATION = (
    "cerrar", "imprimir", "volver", "siguiente", "anterior", "inicio", "atrás", "atras", "tancar", "tornar", "bienvenidos", "ongi etorri", "benvinguts", "benvidos", "welcome", "bienvenue", "home", "search", "contractor profile",
    "companies", "información legal", "informacion legal", "suscribir alertas anuncio", "acuerdos sobre contratación c.a.e.", "acuerdos sobre contratacion c.a.e.", "plazo cerrado", "abierto / plazo de presentación",
    "abierto / plazo de presentacion", "descargar", "descargar todos los archivos", "búsqueda de poderes adjudicadores", "busqueda de poderes adjudicadores", "acceso poderes adjudicadores",
)


def skip_reason(title: Column, confidence_rank: Column, min_rank: int = 0) -> Column:
    """Why a candidate is dropped, null if it is kept; the first reason counts."""
    t = F.lower(F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " ")))
    return F.when(confidence_rank < min_rank, "below_min_confidence").when(t == "ver", "ver_title").when(t.contains("deferred modules"), "deferred_modules").when(t.isin("html", "xml", "documento html", "documento xml"), "generic_html_xml").when(t.isin(*NAVIGATION), "generic_nav")


def best_candidates(candidates: DataFrame, record: str, position: str, cap: int = 10) -> DataFrame:
    """One candidate for each URL of a record (titled, confident, specific first), the best ``cap`` of them,
    without html or xml variants where the family has a PDF."""
    from ..functions.notices import mapped

    rank = mapped(CONFIDENCE, F.col("confidence"), 0)
    kind_rank = mapped({"pliego_admin": 5, "pliego_tecnico": 5, "award_doc": 4, "annex": 3, "generic_doc": 2, "unknown": 1}, F.col("kind"), 0)
    rows = candidates.withColumns({"c_rank": rank, "k_rank": kind_rank})
    one = best_of(rows, [record, "url"], [F.trim("text") != "", F.col("c_rank"), F.col("k_rank"), -F.col(position)])
    pdf = (F.col("extension") == "pdf") | F.lower("text").contains("pdf")
    variant = F.col("extension").isin("", "gateway") & F.lower("text").rlike("html|xml") & ~pdf
    with_family = one.withColumn("_f", F.coalesce("family", "url"))
    has_pdf = F.max(pdf.cast("int")).over(Window.partitionBy(record, "_f"))
    chosen = with_family.withColumn("_p", has_pdf).where(~(variant & (F.col("_p") == 1))).drop("_p", "_f")
    return top_n(chosen, [record], [F.desc("c_rank"), F.desc("k_rank"), F.col(position)], cap)


def cascade_join(rows: DataFrame, records: DataFrame, id_col: str, key_col: str, enriched: str, position: str) -> DataFrame:
    """rows (id, key) joined to records: by unique id, else by unique (id, key), else to the one
    enriched copy of the id, else ambiguous or unmatched. Adds record (its position) and join_method."""
    by_id = records.groupBy(id_col).agg(
        F.count("*").alias("n_id"), F.min(position).alias("one_id"), F.count_if(F.col(enriched)).alias("n_rich"), F.min(F.when(F.col(enriched), F.col(position))).alias("one_rich"),
    )
    by_key = records.groupBy(id_col, key_col).agg(F.count("*").alias("n_key"), F.min(position).alias("one_key"))
    j = rows.join(by_id, id_col, "left").join(by_key, [id_col, key_col], "left")
    method = (
        F.when(F.col("n_id").isNull(), "unmatched").when(F.col("n_id") == 1, "id").when(F.col("n_key") == 1, "id_and_key").when(F.col("n_rich") == 1, "enriched_copy").otherwise("ambiguous")
    )
    record = F.when(method == "id", F.col("one_id")).when(method == "id_and_key", F.col("one_key")).when(method == "enriched_copy", F.col("one_rich"))
    return j.withColumn("join_method", method).withColumn("record", record).drop("n_id", "one_id", "n_rich", "one_rich", "n_key", "one_key")


def url_collisions(rows: DataFrame, url: str, ident: str) -> DataFrame:
    """(url, ids): URLs that belong to several ids."""
    return rows.groupBy(url).agg(F.count_distinct(ident).alias("ids")).where("ids > 1")


# Types and extensions of documents and of markup.
MARKUP_TYPES = ("text/html", "application/xhtml+xml", "text/xml", "application/xml")
DOCUMENT_TYPES = {
    "application/pdf": "pdf", "application/msword": "doc", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/vnd.ms-excel": "xls",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx", "application/vnd.ms-powerpoint": "ppt",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx", "application/vnd.oasis.opendocument.text": "odt",
    "application/vnd.oasis.opendocument.spreadsheet": "ods", "application/rtf": "rtf", "application/zip": "zip", "application/x-zip-compressed": "zip",
}
DOCUMENT_EXTENSIONS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "odp", "rtf", "zip", "7z")


def disposition_name(header: Column) -> Column:
    """The file name of a Content-Disposition header, its extended form first; '' if none."""
    extended = F.try_url_decode(F.regexp_extract(header, r"(?i)filename\*\s*=\s*[\w\-]*'[^']*'([^;]+)", 1))
    plain = F.regexp_extract(header, r'(?i)filename\s*=\s*"?([^";]+)"?', 1)
    return F.coalesce(F.nullif(F.trim(extended), F.lit("")), F.trim(plain), F.lit(""))


def resolution(final_url: Column, status: Column, mime: Column, disposition: Column, magic: Column, candidate_id: Column, canonical_key: Column) -> Column:
    """struct(filename, extension, is_pdf, is_document, status, blockers, merge_ready) of a response's metadata.

    The extension comes from the file name, else from the type, else from the address, else
    from the first bytes. What keeps a response from a merge is listed in order.
    """
    from ..functions.notices import let

    magic = F.coalesce(magic, F.lit(""))
    given = F.struct(F.lower(F.trim(F.regexp_replace(F.coalesce(mime, F.lit("")), ";.*$", ""))).alias("mime"), disposition_name(F.coalesce(disposition, F.lit(""))).alias("name"), magic.alias("magic"))
    by_type = F.create_map(*(F.lit(x) for pair in DOCUMENT_TYPES.items() for x in pair))
    suffix = lambda c: F.nullif(F.lower(F.regexp_extract(c, r"\.([A-Za-z0-9]{1,5})$", 1)), F.lit(""))

    def kinds(x: Column) -> Column:
        of_magic = F.when(x["magic"].isin("pdf", "zip", "rtf"), x["magic"]).when(x["magic"] == "ole", "doc")
        ext = F.coalesce(suffix(x["name"]), by_type[x["mime"]], suffix(F.regexp_extract(F.coalesce(final_url, F.lit("")), "^([^?#]*)", 1)), of_magic, F.lit(""))
        return F.struct(x["name"].alias("name"), x["magic"].alias("magic"), ext.alias("ext"), F.when((x["magic"] == "pdf") & (x["mime"] == ""), "application/pdf").otherwise(x["mime"]).alias("mime"))

    def judged(x: Column) -> Column:
        markup, known = x["mime"].isin(*MARKUP_TYPES), x["ext"].isin(*DOCUMENT_EXTENSIONS)
        pdf = (x["mime"] == "application/pdf") | (x["ext"] == "pdf") | (x["magic"] == "pdf")
        document = (pdf | known | x["mime"].isin(*DOCUMENT_TYPES) | ((x["mime"] == "application/octet-stream") & x["magic"].isin("pdf", "zip", "ole", "rtf"))) & ~markup
        resolved = F.coalesce(status.isin(200, 206), F.lit(False))
        return F.struct(x["name"].alias("name"), x["ext"].alias("ext"), pdf.alias("pdf"), document.alias("document"), markup.alias("markup"), resolved.alias("resolved"))

    def answer(x: Column) -> Column:
        blockers = F.array_compact(F.array(
            F.when(~x["resolved"], "not_resolved"), F.when(~x["document"], "not_document"), F.when(x["markup"], "html_page"), F.when(truthy(final_url).isNull(), "no_final_url"),
            F.when(truthy(candidate_id).isNull(), "no_candidate_id"), F.when(truthy(canonical_key).isNull(), "no_canonical_key"),
        ))
        return F.struct(
            x["name"].alias("filename"), x["ext"].alias("extension"), x["pdf"].alias("is_pdf"), x["document"].alias("is_document"), F.when(x["resolved"], "resolved").otherwise("unresolved").alias("status"),
            blockers.alias("blockers"), (F.size(blockers) == 0).alias("merge_ready"),
        )

    return let(let(let(given, kinds), judged), answer)  # each step's values are computed once a row


def absolute_url(base: Column, href: Column) -> Column:
    """href resolved against the address of its page; '.' and '..' steps are taken."""
    from ..functions.notices import let

    href, root = F.trim(href), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(F.substr(base, F.length(root) + 1), r"^([^?#]*)", 1)
    rest = F.regexp_extract(href, r"([?#].*)$", 1)
    target = F.regexp_replace(href, r"[?#].*$", "")
    target = F.when(target.startswith("/"), target).otherwise(F.concat(F.regexp_replace(path, "[^/]*$", ""), target))
    steps = F.aggregate(
        F.split(target, "/"), F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)).when(s == ".", done).otherwise(F.array_append(done, s)),
    )
    ends_in_folder = target.rlike(r"(^|/)\.\.?$")
    clean = let(F.concat(F.array_join(steps, "/"), F.when(ends_in_folder, "/").otherwise("")), lambda c: F.when(c.startswith("/"), c).otherwise(F.concat(F.lit("/"), c)))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (F.coalesce(root, F.lit("")) == ""), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(root, "^([^:]*:)", 1), href))
        .when(href == "", F.regexp_replace(base, "#.*$", "")).when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(root, path, href)).otherwise(F.concat(root, clean, rest))
    )


def magic_kind(content: Column) -> Column:
    """The kind of a binary column by its first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), "zip").when(head.startswith("D0CF11E0"), "doc").when(head.startswith("3C"), "markup").otherwise("other")


def resolver_summary(rows: DataFrame, ok: Column, document: Column, error: Column) -> DataFrame:
    """Counts and ratios of a resolver run, one row."""
    c = rows.agg(F.count("*").alias("total"), F.count_if(ok).alias("resolved"), F.count_if(document).alias("documents"), F.count_if(error).alias("errors"))
    return c.select("*", *(ratio(F.col(x), F.col("total")).alias(f"{x}_ratio") for x in ("resolved", "documents", "errors")))


def with_skips(candidates: DataFrame, record: str, min_rank: int = 0) -> DataFrame:
    """candidates (text, confidence, extension, family, ...) with ``skipped``: why each is dropped, null if it is kept.

    After the rules on titles, those that are left are looked at by family: where one is a
    PDF, variants in HTML or XML give way to it.
    """
    from ..functions.notices import mapped

    rows = candidates.withColumn("skipped", skip_reason(F.col("text"), mapped(CONFIDENCE, F.col("confidence"), 0), min_rank))
    title = F.lower(F.coalesce("text", F.lit("")))
    left = F.col("skipped").isNull() & F.col("family").isNotNull()
    pdf = left & ((F.col("extension") == "pdf") | title.contains("pdf"))
    variant = left & F.coalesce("extension", F.lit("")).isin("", "gateway") & title.rlike("html|xml") & ~title.contains("pdf")
    has = F.max(F.coalesce(pdf, F.lit(False))).over(Window.partitionBy(record, "family"))
    return rows.withColumn("skipped", F.when(variant & has, "pdf_preferred").otherwise(F.col("skipped")))
