"""Summaries of runs: all counts, histograms and top lists of a run from one scan and one aggregation.

Each row gives a few (measure, value) pairs: a count's condition that holds, the value of
each histogram. They are grouped once, with partial counts before the shuffle, so a hot
value costs one row a task. Ratios come from the counts. The result is long: (section,
measure, value, place, n); ``wide`` turns counts and ratios into one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import notices as N
from ..functions import tables as T
from ..functions.semantics import norm_ws
from .dedup import accepted_only_duplicates, top_n

#: How many values the top lists show, and how many rows a sample has.
TOP_TITLES, TOP_FILES, TOP_ERRORS, SAMPLE = 15, 15, 10, 20
#: Titles that say nothing, in lower case.
GENERIC_TITLES = ("ver", "documento html", "documento xml", "documento pdf", "deferred modules")


def tally(
    rows: DataFrame, counts: Mapping[str, Column], histograms: Mapping[str, Column], top: Mapping[str, int] | None = None, position: str | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """(keys..., section, measure, value, place, n): counts of conditions, histograms of values, and the most frequent values.

    A histogram skips nulls. A measure in ``top`` keeps its so many most frequent values,
    ranked by place from 1, ties by first position and then by value. Groups without rows
    have no rows here; a condition that never holds has no row either (see ``wide``).
    """
    top = top or {}
    pair = lambda m, v: F.struct(F.lit(m).alias("measure"), v.alias("value"))
    pairs = [F.when(c, pair(m, F.lit(None).cast("string"))) for m, c in counts.items()]
    pairs += [F.when(c.isNotNull(), pair(m, c.cast("string"))) for m, c in histograms.items()]
    at = F.col(position) if position else F.lit(0)
    long = rows.select(*keys, at.alias("_at"), F.explode(F.array_compact(F.array(*pairs))).alias("p"))
    sums = long.groupBy(*keys, F.col("p.measure").alias("measure"), F.col("p.value").alias("value")).agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    place = F.lit(None).cast("int")
    if top:
        own = F.row_number().over(Window.partitionBy(*keys, "measure").orderBy(F.desc("n"), F.asc("_first"), F.asc("value")))
        limit = F.coalesce(*(F.when(F.col("measure") == m, k) for m, k in top.items()))
        ranked = sums.where(F.col("measure").isin(*top)).withColumn("place", own).where(F.col("place") <= max(top.values())).where(F.col("place") <= limit)
        sums = sums.where(~F.col("measure").isin(*top)).withColumn("place", place).unionByName(ranked)
    else:
        sums = sums.withColumn("place", place)
    section = F.when(F.col("place").isNotNull(), "top").when(F.col("measure").isin(*counts), "count").otherwise("histogram")
    return sums.select(*keys, section.alias("section"), "measure", "value", "place", F.col("n").cast("double").alias("n"))


def wide(tallied: DataFrame, counts: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row (a group): each count, 0 where its condition never held."""
    one = lambda c: F.coalesce(F.max(F.when((F.col("section") == "count") & (F.col("measure") == c), F.col("n"))), F.lit(0.0)).cast("long").alias(c)
    return tallied.groupBy(*keys).agg(*map(one, counts))


def with_ratios(row: DataFrame, ratios: Mapping[str, tuple[str, str]], digits: int = 6) -> DataFrame:
    """row with the ratio of two of its counts for each name, 0 over nothing."""
    of = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)), digits)
    return row.withColumns({name: of(a, b) for name, (a, b) in ratios.items()})


def stated_first(row: DataFrame, stated: DataFrame | None) -> DataFrame:
    """row with the measures that a manifest states (one row, null where it is silent) in place of those that were computed."""
    if stated is None:
        return row
    mine = [c for c in row.columns if c in stated.columns]
    said = stated.select(F.lit(1).alias("_one"), *(F.col(c).alias(f"_{c}") for c in mine)).groupBy().agg(*(F.max(f"_{c}").alias(f"_{c}") for c in mine))
    joined = row.crossJoin(said)  # one row each
    return joined.select(*(F.coalesce(F.col(f"_{c}").cast(t), F.col(c)).alias(c) if c in mine else F.col(c) for c, t in row.dtypes))


# --- candidate links ------------------------------------------------------------------------


def _title() -> Column:
    return F.trim(F.coalesce("title", F.lit("")))


def link_summary(candidates: DataFrame, records: DataFrame, nav_titles: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Histograms and counts of a discovery run.

    candidates (position, title, confidence, kind, extension, source_domain) are those that
    stayed; records (before_filter, kept, error, capped, duplicates, skipped map of counts by
    reason) one row for each record that was tried. The second result is one row of counts and
    ratios.
    """
    of = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    histograms = {"title": _title(), "confidence": of("confidence", "low"), "kind": of("kind", "unknown"), "extension": of("extension", ""), "source_domain": of("source_domain", "")}
    nav = F.lower(F.regexp_replace(_title(), r"(?U)\s+", " "))
    counts = {"candidates_after_filter": F.lit(True), "generic_title_count": F.lower(_title()).isin(*GENERIC_TITLES), "nav_title_count": nav.isin(*nav_titles) if nav_titles else F.lit(False)}
    long = tally(candidates, counts, histograms, {"title": TOP_TITLES}, "position")
    skips = records.select(F.explode(F.coalesce("skipped", F.create_map().cast("map<string,bigint>"))).alias("value", "k")).groupBy("value").agg(F.sum("k").cast("double").alias("n"))
    skips = skips.select(F.lit("histogram").alias("section"), F.lit("skipped").alias("measure"), "value", F.lit(None).cast("int").alias("place"), "n")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    of_records = records.agg(
        F.count("*").alias("records_attempted"), F.count_if(F.col("kept") > 0).alias("records_with_candidates"), total("before_filter").alias("candidates_before_filter"), F.count_if(F.col("error").isNotNull()).alias("error_count"),
        F.count_if("capped").alias("capped_records_count"), total("duplicates").alias("duplicate_url_count"),
    )
    row = of_records.crossJoin(wide(long, list(counts)))  # one row each
    ratios = {"error_rate": ("error_count", "records_attempted"), "records_with_candidates_ratio": ("records_with_candidates", "records_attempted"), "generic_title_ratio": ("generic_title_count", "candidates_after_filter")}
    return long.unionByName(skips), with_ratios(row, ratios)


def media_base(content_type: Column) -> Column:
    """A content type without its parameters, in lower case."""
    return F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))


RESOLVER_RATIOS = {
    "resolver_error_rate": ("error_count", "candidates_attempted"), "resolved_ratio": ("resolved_count", "candidates_attempted"), "resolved_pdf_ratio": ("resolved_pdf_count", "candidates_attempted"),
    "resolved_document_ratio": ("resolved_document_count", "candidates_attempted"), "merge_ready_candidate_ratio": ("merge_ready_candidate_count", "candidates_attempted"),
}


def resolver_report(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Histograms, and one row of counts and ratios, of a resolver run.

    rows (position, status, is_pdf, is_document, merge_ready, source_domain, final_domain,
    content_type, extension, method, filename, error_type); a skipped candidate is an error.
    """
    status = F.coalesce("status", F.lit(""))
    counts = {
        "candidates_attempted": F.lit(True), "resolved_count": status == "resolved", "unresolved_count": status == "unresolved", "error_count": status.isin("error", "skipped"), "resolved_pdf_count": F.col("is_pdf"),
        "resolved_document_count": F.col("is_document"), "merge_ready_candidate_count": F.col("merge_ready"), "unresolved_after_resolver_count": status.isin("unresolved", "error", "skipped"),
    }
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    histograms = {
        "per_domain": text("source_domain"), "per_domain_resolved": F.when(status == "resolved", text("source_domain")), "final_domain": given("final_domain"), "content_type": media_base(F.col("content_type")),
        "inferred_extension": text("extension"), "resolver_method": text("method"), "resolver_status": status, "filename": given("filename"), "error_type": given("error_type"),
    }
    long = tally(rows, counts, histograms, {"filename": TOP_FILES, "error_type": TOP_ERRORS}, "position")
    return long, with_ratios(wide(long, list(counts)), RESOLVER_RATIOS)


def gate_measures(candidates: DataFrame, records: DataFrame, required: Sequence[str], nav_like: Sequence[str], stated: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Histograms, and the one row of measures that quality_verdicts reads; what ``stated`` says goes before what is computed.

    candidates (position, title, normalized_title, kind, extension, source_domain, confidence,
    needs_resolver, merge_ready, fields: names it has); records (kept, error). Generic and
    navigation titles, gateways and kinds are always computed.
    """
    title = F.lower(F.coalesce("normalized_title", F.lit("")))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    ready = F.coalesce("merge_ready", F.lit(False))
    counts = {
        "candidates_after_filter": F.lit(True), "generic_title_count": title.isin(*GENERIC_TITLES), "nav_like_survivor_count": title.isin(*nav_like), "unresolved_gateway_count": (text("extension") == "gateway") | F.coalesce("needs_resolver", F.lit(False)),
        "unknown_kind_count": F.col("kind") == "unknown", "high_confidence_count": F.col("confidence") == "high", "medium_confidence_count": F.col("confidence") == "medium", "low_confidence_count": F.col("confidence") == "low",
        "missing_v2_field_count": F.size(F.array_except(F.array(*map(F.lit, required)), F.coalesce("fields", F.array().cast("array<string>")))) > 0, "merge_ready_true_count": ready, "merge_ready_false_count": ~ready,
    }
    long = tally(candidates, counts, {"per_domain": text("source_domain"), "kind": text("kind"), "extension": text("extension"), "title": _title()}, {"title": TOP_TITLES}, "position")
    of_records = records.agg(F.count("*").alias("records_attempted"), F.count_if(F.col("kept") > 0).alias("records_with_candidates"), F.count_if(F.col("error").isNotNull()).alias("error_count"), F.lit(0).cast("long").alias("nav_title_count"))
    row = of_records.crossJoin(wide(long, list(counts)).withColumn("candidates_before_filter", F.col("candidates_after_filter")))  # one row each
    row = stated_first(row, stated.drop(*(c for c in counts if not c.endswith("confidence_count")), "error_rate", "records_with_candidates_ratio") if stated is not None else None)
    ratios = {
        "records_with_candidates_ratio": ("records_with_candidates", "records_attempted"), "generic_title_ratio": ("generic_title_count", "candidates_after_filter"), "unresolved_gateway_ratio": ("unresolved_gateway_count", "candidates_after_filter"),
        "unknown_kind_ratio": ("unknown_kind_count", "candidates_after_filter"), "high_confidence_ratio": ("high_confidence_count", "candidates_after_filter"),
    }
    return long, with_ratios(with_ratios(row, ratios), {"error_rate": ("error_count", "records_attempted")}, 8)


def samples(rows: DataFrame, kinds: Mapping[str, Column], columns: Sequence[str], position: str, most: int = SAMPLE) -> DataFrame:
    """(kind, columns...): the first ``most`` rows of each kind, from one scan; a row can be of several kinds."""
    named = F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in kinds.items())))).alias("kind")
    return top_n(rows.select(named, *columns, position), ["kind"], [F.asc(position)], most)


# --- merges and documents -------------------------------------------------------------------


def merge_report(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Histograms of reasons and join methods, and one row of counts, of what ``persistence`` made of the candidates (ready, join_method, reason)."""
    reason, method = F.col("reason"), F.col("join_method")
    double = reason.isin("duplicate_final_url", "duplicate_evidence_final_url", "existing_document_url")
    joined = F.coalesce(method.isin("id", "id_and_key", "enriched_copy"), F.lit(False))
    early = reason.isNotNull() & ~double & ~reason.isin("record_not_found", "ambiguous_record")
    reached = ~F.coalesce(early, F.lit(False))
    counts = {
        "resolved_seen": F.lit(True), "merge_ready_seen": F.coalesce("ready", F.lit(False)), "accepted_documents": reason.isNull(), "duplicates": F.coalesce(double, F.lit(False)), "blocked_documents": reason.isNotNull() & ~double,
        "duplicate_evidence_rows": reason == "duplicate_evidence_final_url", "html_non_doc_blocked": reason.isin("html_page", "not_document"), "production_records_matched": reached & joined, "production_records_missing": reason == "record_not_found",
        "ambiguous_record_join_remaining": reason == "ambiguous_record", "unmatched_rows": reason.isin("record_not_found", "ambiguous_record", "record_id_missing"), "resolved_via_strict_id": reached & (method == "id"),
        "resolved_via_strict_id_canonical_key": reached & (method == "id_and_key"), "resolved_via_enriched_fallback": reached & (method == "enriched_copy"),
    }
    long = tally(rows, counts, {"reason": F.coalesce(reason, F.lit("accepted")), "join_method": F.when(reached, method), "duplicate_join_method": F.when(double, method), "blocked_reason": F.when(reason.isNotNull() & ~double, reason)})
    return long, wide(long, list(counts))


def document_report(documents: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Histograms of roles, types and states of documents (role, detected_type, extraction_status, ocr_needed) and of states of records (record_status), and one row of counts."""
    status = F.coalesce("extraction_status", F.lit(""))
    counts = {
        "documents": F.lit(True), "attempted": status != "selected_only", **{s: status == s for s in ("extracted", "partial_parse", "text_empty", "unsupported_type", "download_failed", "too_large", "timeout", "parse_failed")},
        "ocr_needed_documents": F.coalesce("ocr_needed", F.lit(False)),
    }
    of_documents = tally(documents, counts, {"role": F.nullif(F.col("role"), F.lit("")), "detected_type": F.nullif(F.col("detected_type"), F.lit("")), "extraction_status": status})
    more = {"records": F.lit(True), "source_link_only_records": F.col("record_status") == "source_link_only"}
    of_records = tally(records, more, {"record_status": F.col("record_status")})
    long = of_documents.unionByName(of_records)
    return long, wide(long, [*counts, *more])


def discard_reasons(entries: DataFrame, least: int, title_words: Sequence[str] = T.TITLE_IN, title_out: Sequence[str] = T.TITLE_OUT) -> DataFrame:
    """entries (position, ident, title, content, cpv) with score and reason: no_title, title_gate, dup, low_score, null for those taken.

    An entry is a duplicate if an earlier one of its ident was taken; entries that were not
    taken block none. The first rule that fits counts.
    """
    title = norm_ws(F.col("title"))
    gate = ~N.contains_any(title, list(title_out)) & N.contains_any(title, list(title_words))
    rows = entries.withColumns({"score": N.score(F.col("title"), F.col("content"), F.col("cpv"), title_words=list(title_words)), "_gate": F.coalesce(gate, F.lit(False)), "_titled": F.coalesce(F.col("title"), F.lit("")) != ""})
    rows = rows.withColumn("_dup", accepted_only_duplicates(rows, ["ident"], "position", F.col("_titled") & F.col("_gate") & (F.col("score") >= least)))
    reason = F.when(~F.col("_titled"), "no_title").when(~F.col("_gate"), "title_gate").when(F.col("_dup"), "dup").when(F.col("score") < least, "low_score")
    return rows.withColumn("reason", reason).drop("_gate", "_titled", "_dup")


def discards(entries: DataFrame, reason: Column, score: Column, position: str, evidence: Sequence[str], most: int = 500) -> tuple[DataFrame, DataFrame]:
    """Why entries of a feed were not taken: counts and a histogram of scores, and at most ``most`` rows of evidence for each reason.

    reason is null for an entry that is taken. The histogram counts the scores of entries that
    were too low, under the reason low_score. Evidence is the first rows by position.
    """
    rows = entries.withColumns({"_reason": reason, "_score": score})
    named = F.col("_reason")
    counts = {
        "observed_entries_count": F.lit(True), "candidate_id_count": F.coalesce(~named.isin("no_title", "title_gate"), F.lit(True)), "accepted_count": named.isNull(), "discarded_count": named.isNotNull(),
        **{r: named == r for r in ("no_title", "title_gate", "low_score", "dup")},
    }
    long = tally(rows, counts, {"low_score_by_score": F.when(named == "low_score", F.col("_score"))})
    shown = top_n(rows.where("_reason IS NOT NULL"), ["_reason"], [F.asc(position)], most)
    return long, shown.select(F.col("_reason").alias("reason"), F.col("_score").alias("score"), position, *evidence)
