"""Which documents to read: eligibility, capped selection of targets, roles matched to sections."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import truthy
from ..functions.texts import endpoint_family
from .dedup import best_of

LEGAL, TECHNICAL = "legaldocumentreference", "technicaldocumentreference"
#: Fixed value: the section of a record's documents in which a role is filed.
SECTION_BY_ROLE = {"pcap": LEGAL, "ppt": TECHNICAL, "anexo": "additionalpublicationdocumentreference", "declaracion": "additionalpublicationdocumentreference", "modelo": "additionalpublicationdocumentreference", "oferta": "additionalpublicationdocumentreference"}


def record_eligible(years: tuple[str, ...] = ("2025", "2026")) -> Column:
    """Open records (data_pub, active_opportunity_eligible, adjudicatari, award_results, winner_provenance) of the years, without any sign of an award."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    won = F.exists(F.coalesce("award_results", F.array().cast("array<struct<winning_party_name:string>>")), lambda a: F.trim(F.coalesce(a["winning_party_name"], F.lit(""))) != "")
    return F.coalesce(F.left("data_pub", F.lit(4)).isin(*years), F.lit(False)) & F.coalesce("active_opportunity_eligible", F.lit(False)) & blank("adjudicatari") & ~won & blank("winner_provenance")


def document_eligible(doc: Column, excluded: tuple[str, ...] = ("ACTA_ADJ", "ACTA_FORM")) -> Column:
    """Resolved PDF documents with an address and no failed answer that are no minutes."""
    status = doc["http_status"]
    return (
        F.coalesce(doc["provenance"] == "f2b_resolver", F.lit(False)) & F.coalesce(doc["mime_hint"] == "application/pdf", F.lit(False)) & (F.trim(F.coalesce(doc["url"], F.lit(""))) != "")
        & (status.isNull() | (status == 200)) & ~F.coalesce(doc["document_type"], F.lit("")).isin(*excluded)
    )


def deadline_valid(deadline: Column, today: date) -> Column:
    return F.coalesce(F.try_to_date(F.left(deadline, F.lit(10))) >= F.lit(today), F.lit(False))


def target_order(in_sample: Column, status: Column, year: Column, key: str) -> list[Column]:
    """Values that sort sampled records first, then open ones, the latest years, and by key."""
    return [F.when(in_sample, 0).otherwise(1), F.when(status == "Vigente", 0).otherwise(1), F.coalesce(-year.try_cast("int"), F.lit(1)), F.coalesce(F.col(key), F.lit(""))]


def select_targets(docs: DataFrame, order: list[Column], record: str, position: str, max_records: int, max_urls: int, per_record: int) -> DataFrame:
    """Addresses to read: docs (record, position, provenance, source_section, url, and what order names).

    Legal and technical documents of a record take turns, at most ``per_record`` of them
    before repeated addresses go; an address counts at its first record only; at most
    ``max_records`` records and ``max_urls`` addresses in order. The caps bound the result,
    so the sums over records run over the few that they can reach.
    """
    own = docs.where(F.coalesce(F.col("provenance") == "feed_xml", F.lit(False)) & F.col("source_section").isin(LEGAL, TECHNICAL) & F.lower(F.trim("url")).startswith("http")).withColumn("url", F.trim("url"))
    turn = F.row_number().over(Window.partitionBy(record, "source_section").orderBy(position))
    place = F.row_number().over(Window.partitionBy(record).orderBy("_turn", F.when(F.col("source_section") == LEGAL, 0).otherwise(1)))
    own = own.withColumn("_turn", turn).withColumn("_place", place).where(F.col("_place") <= per_record)
    rank = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.col(record).alias("r"), F.col("_place").alias("p"))
    first = own.withColumn("_rank", rank)
    first = first.groupBy("url").agg(F.min_by(F.struct(*first.columns), "_rank").alias("f")).select("f.*")
    # The first max_urls addresses in order are all that any result can hold.
    few = first.orderBy("_rank").limit(max_urls)
    groups = few.groupBy(record).agg(F.min("_rank").alias("_g")).orderBy("_g").limit(max_records).select(record)
    return few.join(F.broadcast(groups), record, "left_semi").withColumn("endpoint_family", endpoint_family(F.col("url"))).orderBy("_rank").drop("_turn", "_rank")


def matched_references(references: DataFrame, documents: DataFrame, record: str) -> DataFrame:
    """references (record, role) with the document of the record that the role's section holds.

    Adds section, matched, confidence, url, resolvable, reason and gap: one addressed
    document of a legal or technical section is sure, several are ambiguous, none is a gap.
    """
    section = F.create_map(*(F.lit(x) for pair in SECTION_BY_ROLE.items() for x in pair))[F.col("role")]
    own = documents.where(F.col("provenance") == "feed_xml").groupBy(record, F.col("source_section").alias("section"))
    own = own.agg(F.count("*").alias("slots"), F.count(truthy(F.trim("url"))).alias("urls"), F.min_by(F.trim("url"), F.when(truthy(F.trim("url")).isNotNull(), F.col("position"))).alias("url"))
    j = references.withColumn("section", section).join(own, [record, "section"], "left")
    sure = F.col("role").isin("pcap", "ppt") & (F.col("urls") == 1)
    some, slots = F.coalesce(F.col("urls") > 0, F.lit(False)), F.coalesce(F.col("slots"), F.lit(0)) > 0
    return j.withColumns({
        "matched": some, "confidence": F.when(some & sure, "high").when(some, "medium").when(slots, "low").otherwise("none"), "url": F.when(some, F.col("url")), "resolvable": some,
        "reason": F.when(F.col("section").isNull(), "no_role_to_section_mapping").when(some & sure, "single_document_of_section").when(some, "ambiguous_documents_of_section").when(slots, "section_without_url").otherwise("no_document_of_section"),
        "gap": F.when(some, "url_not_yet_resolved").when(slots, "file_name_only").otherwise("not_present_as_document"),
    }).drop("slots", "urls")


def url_roles(documents: DataFrame, roles: DataFrame) -> DataFrame:
    """documents with the role that a table (url, role) gives their address, null if none."""
    one = roles.groupBy("url").agg(F.min("role").alias("role"))
    return documents.join(one, "url", "left")


def bridged(rows: DataFrame, candidates: DataFrame, position: str) -> DataFrame:
    """rows (candidate_id) with the record of their candidate, that of the last one of an id."""
    last = candidates.where(truthy(F.col("candidate_id")).isNotNull()).groupBy("candidate_id").agg(F.max_by("record_id", position).alias("record_id"))
    return rows.join(last, "candidate_id", "left")


def grouped_plan(accepted: DataFrame, record: str, position: str) -> DataFrame:
    """(record, n, documents): the documents to append to each record, in order."""
    fields = F.struct(F.col(position).alias("position"), *(c for c in accepted.columns if c not in (record, position)))
    return accepted.groupBy(record).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(fields)).alias("documents"))


def with_record_documents(records: DataFrame, ident: str, key: str, position: str, documents: str = "documents") -> DataFrame:
    """One record for each (id, key), null ones too: the first that has documents, else the first."""
    return best_of(records, [ident, key], [F.coalesce(F.size(documents), F.lit(0)) > 0, -F.col(position)])


def labelled_documents(documents: DataFrame, roles: DataFrame, records: DataFrame, position: str = "position") -> DataFrame:
    """documents (record_id, canonical_key, doc_sha256, url) with the role of their digest and the documents that production lists for their record.

    roles (doc_sha256, role, position): the last role of a digest counts. records (record_id,
    canonical_key, position, documents). Documents without either keep nulls, and each stays one row.
    """
    last = roles.where(truthy(F.col("doc_sha256")).isNotNull()).groupBy("doc_sha256").agg(F.max_by("role", position).alias("role"))
    chosen = with_record_documents(records, "record_id", "canonical_key", position).select(F.col("record_id").alias("_r"), F.col("canonical_key").alias("_k"), F.col("documents").alias("record_documents"))
    out = documents.join(last, "doc_sha256", "left")
    return out.join(chosen, F.col("record_id").eqNullSafe(F.col("_r")) & F.col("canonical_key").eqNullSafe(F.col("_k")), "left").drop("_r", "_k")
