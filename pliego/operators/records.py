"""Records: clean-up, selection, document lists, the persistence cascade, run summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import pct, truthy
from .dedup import first_accepted
from .evidence import cascade_join, normal_url

NOTICE_ROLES = {
    "PUB": "notice_publication", "AWARD": "notice_award", "RES": "notice_resolution", "EV": "notice_evaluation", "PRE": "notice_preliminary",
    "CONTRACT_MODIFICATION": "notice_contract_modification",
}


def clean_source(source: Column) -> Column:
    return F.when(source.rlike("^LOCAL(-ZIP)?$"), "PLACSP").otherwise(source)


def clean_awardee(awardee: Column) -> Column:
    """Placeholder texts become blank; tags go and white space collapses."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(awardee, "<[^>]+>", ""), r"(?U)\s+", " "))
    return F.when(awardee.rlike("(?i)detalle|adjudicaci"), "").otherwise(plain)


def valid_https(url: Column) -> Column:
    """Whether a text is an https URL with a host."""
    return F.coalesce((F.lower(F.try_parse_url(F.trim(url), F.lit("PROTOCOL"))) == "https") & (F.try_parse_url(F.trim(url), F.lit("HOST")) != ""), F.lit(False))


def folded_contains(text: Column, query: str) -> Column:
    """Whether a text contains another, without regard to case and accents."""
    return F.contains(F.collate(text, "UNICODE_CI_AI"), F.collate(F.lit(query), "UNICODE_CI_AI"))


def first_letter(name: Column) -> Column:
    """The unaccented upper-case first letter of a name, '#' for others."""
    c = F.upper(F.translate(F.lower(F.left(F.trim(name), F.lit(1))), "áàâäãéèêëíìîïóòôöõúùûüñç", "aaaaaeeeeiiiiooooouuuunc"))
    return F.when(c.rlike("^[A-Z]$"), c).otherwise("#")


def ui_order(tier: Column, column: str, text: bool, descending: bool = False) -> list[Column]:
    """Sort keys of a table view: tier first, then a column with missing values last; texts in Spanish order."""
    c = F.collate(F.col(column), "es") if text else F.col(column)
    return [tier.asc(), c.desc_nulls_last() if descending else c.asc_nulls_last()]


def selected(df: DataFrame, has_documents: Column, position: str, limit: int, *conditions: Column) -> DataFrame:
    """Records that meet all conditions, those with documents first, in order, at most ``limit``."""
    for c in conditions:
        df = df.where(c)
    return df.orderBy(has_documents.desc(), position).limit(limit)


def unresolved(candidates: DataFrame, checkpoint: DataFrame, ident: str) -> DataFrame:
    """Candidates that a checkpoint does not hold yet."""
    return candidates.join(checkpoint.select(ident).distinct(), ident, "left_anti")


def document_role(section: Column, kind: Column, notice: Column) -> Column:
    """The role of a document, from its fields alone, by ordered rules."""
    from ..functions.notices import mapped

    s = F.lower(F.trim(section))
    return (
        F.when(s == "legaldocumentreference", "pcap").when(s == "technicaldocumentreference", "ppt").when(kind == "ACTA_ADJ", "award_minutes")
        .when(kind == "ACTA_FORM", "formalization_minutes").when(kind == "pliego_admin", "admin_spec")
        .when((s == "additionalpublicationdocumentreference") & mapped(NOTICE_ROLES, F.upper(F.trim(notice))).isNotNull(), mapped(NOTICE_ROLES, F.upper(F.trim(notice))))
        .when(s == "f2_document_evidence", "tender_document").otherwise("document")
    )


def document_identity(url: Column, original: Column, parts: Sequence[Column]) -> Column:
    """What makes two listed documents the same: URL, else original URL, else descriptive fields; null if none."""
    u, o = (F.when(F.try_parse_url(F.trim(c), F.lit("PROTOCOL")).isNotNull(), F.concat(F.lit("u:"), normal_url(F.trim(c)))) for c in (url, original))
    composite = F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts))
    return F.coalesce(u, o, F.when(F.concat_ws("", *parts) != "", F.concat(F.lit("m:"), composite)))


def distinct_documents(docs: DataFrame, record: str, identity: str, position: str, resolver: Column) -> DataFrame:
    """One row for each identity of a record, at the place of its first one; a resolver's row replaces others.

    Rows without identity all stay.
    """
    keyed, rest = docs.where(F.col(identity).isNotNull()), docs.where(F.col(identity).isNull())
    best = F.max_by(F.struct(*docs.columns), F.struct(resolver, -F.col(position)))
    one = keyed.groupBy(F.col(record).alias("_r"), F.col(identity).alias("_i")).agg(best.alias("d"), F.min(position).alias("_place"))
    out = one.select("d.*", "_place").withColumn(position, F.col("_place")).drop("_place")
    return out.unionByName(rest)


def document_order(section: Column, resolved: Column, published: Column, position: str) -> list[Column]:
    """Legal, technical, resolved, then others by date, newest first; list order breaks ties."""
    s = F.lower(F.trim(section))
    rank = F.when(s == "legaldocumentreference", 0).when(s == "technicaldocumentreference", 1).when(resolved, 2).otherwise(3)
    time = F.when(rank == 3, F.try_to_timestamp(published))
    return [rank.asc(), time.desc_nulls_last(), F.col(position).asc()]


def persistence(candidates: DataFrame, records: DataFrame, existing: DataFrame) -> DataFrame:
    """candidates (pos, candidate_id, record_id, canonical_key, final_url, content_type, is_document, ready, blockers)
    with record, join_method and reason: why each is blocked or a duplicate, null if accepted.

    records has (record_id, canonical_key, enriched, pos); existing has (record_id, url). The
    first rule that fits counts; only candidates that reach the last rules compete for a URL.
    """
    firsts = candidates.groupBy("candidate_id").agg(F.min("pos").alias("_first"))
    rows = candidates.join(firsts, "candidate_id", "left")
    early = (
        F.when(truthy(F.col("candidate_id")).isNull(), "missing_candidate_id").when(F.col("pos") > F.col("_first"), "duplicate_candidate_id")
        .when(truthy(F.col("canonical_key")).isNull(), "missing_canonical_key").when(truthy(F.col("final_url")).isNull(), "missing_final_url")
        .when(F.coalesce(F.col("content_type"), F.lit("")).startswith("text/html"), "html_page").when(~F.coalesce("is_document", F.lit(False)), "not_document")
        .when(~F.coalesce("ready", F.lit(False)), "not_merge_ready").when(F.coalesce(F.size("blockers"), F.lit(0)) > 0, "merge_blockers_present")
        .when(truthy(F.col("record_id")).isNull(), "record_id_missing")
    )
    rows = rows.withColumn("early", early).drop("_first")
    joined = cascade_join(rows, records.withColumnRenamed("pos", "record_pos"), "record_id", "canonical_key", "enriched", "record_pos")
    have = existing.select("record_id", F.col("url").alias("final_url"), F.lit(True).alias("known")).distinct()
    joined = joined.join(have, ["record_id", "final_url"], "left")
    late = F.when(F.col("join_method") == "unmatched", "record_not_found").when(F.col("join_method") == "ambiguous", "ambiguous_record").when(F.col("known"), "existing_document_url")
    joined = joined.withColumn("reason", F.coalesce("early", late)).drop("early", "known")
    open_ = first_accepted(joined.where("reason is null"), ["record_id", "final_url"], "pos", "join_method")
    twice = F.when(~F.col("first"), F.when(F.col("join_method") == "enriched_copy", "duplicate_evidence_final_url").otherwise("duplicate_final_url"))
    return joined.where("reason is not null").unionByName(open_.withColumn("reason", twice).drop("first", "first_label"))


def run_summary(df: DataFrame, status: Column, amount: Column, awardee: Column) -> DataFrame:
    """One row: counts by status, amounts, awardees."""
    known = F.when(amount > 0, amount)
    out = df.agg(
        F.count("*").alias("records"), F.count_if(status == "Vigente").alias("open"), F.count_if(status == "Adjudicado").alias("awarded"), F.count(known).alias("with_amount"),
        F.round(F.sum(known), 2).alias("amount"), F.count_if(awardee != "").alias("with_awardee"),
    )
    return out.withColumn("mean_amount", F.round(F.try_divide("amount", "with_amount"), 2)).withColumn("with_amount_pct", pct(F.col("with_amount"), F.col("records")))


def legacy_merge(previous: DataFrame, incoming: DataFrame, today: str, carried: Sequence[str]) -> DataFrame:
    """Full outer merge on id where the incoming row is taken and blanks are carried over from the previous one.

    Both have (id, estat, adjudicatari, data_pub, historial, carried). A change of status adds
    a line of history; a row seen for the first time starts one.
    """
    from .merge import change_note

    j = previous.withColumn("_here", F.lit(True)).alias("p").join(incoming.withColumn("_here", F.lit(True)).alias("n"), F.col("p.id") == F.col("n.id"), "full_outer")
    p, n = (lambda c: F.col(f"p.{c}")), (lambda c: F.col(f"n.{c}"))
    has_p, has_n = p("_here").isNotNull(), n("_here").isNotNull()
    before, now = F.coalesce(p("estat"), F.lit("Vigente")), F.coalesce(n("estat"), F.lit("Vigente"))
    awardee = F.coalesce(truthy(n("adjudicatari")), truthy(p("adjudicatari")), F.lit(""))
    line = lambda d, note: F.array(F.struct(d.alias("data"), now.alias("estat"), note.alias("nota")))
    old = F.coalesce(p("historial"), F.slice(F.coalesce(n("historial"), p("historial")), 1, 0))
    first = line(F.coalesce(n("data_pub"), F.lit(today)), F.lit("Publicación"))
    history = F.when(~has_n, p("historial")).when(~has_p, first).when(now != before, F.concat(old, line(F.lit(today), change_note(awardee, before, now)))).when(F.size(old) == 0, first).otherwise(old)
    fields = [F.when(has_n, F.coalesce(truthy(n(c)), p(c), n(c))).otherwise(p(c)).alias(c) for c in carried]
    return j.select(
        F.coalesce(n("id"), p("id")).alias("id"), F.when(has_n, now).otherwise(p("estat")).alias("estat"), awardee.alias("adjudicatari"), F.coalesce(n("data_pub"), p("data_pub")).alias("data_pub"),
        history.alias("historial"), *fields, F.when(has_p & has_n, "updated").when(has_n, "new").otherwise("preserved").alias("outcome"),
    )


def existing_urls(records: DataFrame, record: str = "record_id", documents: str = "documents") -> DataFrame:
    """(record_id, url): the addresses of the documents of all rows that share an id, each once."""
    return records.where(truthy(F.col(record)).isNotNull()).select(record, F.explode(F.col(documents)["url"]).alias("url")).where(truthy(F.col("url")).isNotNull()).distinct()


def bridged_persistence(candidates: DataFrame, bridge: DataFrame, records: DataFrame, existing: DataFrame) -> DataFrame:
    """persistence of candidates whose record and key come from a bridge (candidate_id, record_id, canonical_key, pos), with all fifteen reasons.

    The last row of an id in the bridge counts. A candidate that passes the rules on itself
    and is not in the bridge is "candidate_not_found"; its own canonical_key counts for the rule on keys only.
    """
    last = bridge.where(truthy(F.col("candidate_id")).isNotNull()).groupBy("candidate_id").agg(F.max_by(F.struct("record_id", "canonical_key"), "pos").alias("_b"))
    rows = candidates.drop("record_id").join(last, "candidate_id", "left").withColumn("_own", F.col("canonical_key"))
    # A candidate without a key of its own must keep failing for it; the join goes by the bridge's key.
    key = F.when(truthy(F.col("_own")).isNull(), F.col("_own")).otherwise(F.coalesce(truthy(F.col("_b.canonical_key")), F.lit("-")))
    found = persistence(rows.withColumns({"record_id": F.col("_b.record_id"), "canonical_key": key}), records, existing)
    lost = (F.col("reason") == "record_id_missing") & F.col("_b").isNull()
    return found.withColumn("reason", F.when(lost, "candidate_not_found").otherwise(F.col("reason"))).drop("_b", "_own")


def cleaned_item(rows: DataFrame) -> DataFrame:
    """rows (font, adjudicatari) as a view shows them: local sources by their public name, awardees without placeholders, numbered characters, tags and runs of white space."""
    number = F.regexp_extract_all("adjudicatari", F.lit(r"&#(\d{1,6});"), F.lit(1))
    plain = F.aggregate(F.array_distinct(number), F.col("adjudicatari"), lambda text, n: F.replace(text, F.concat(F.lit("&#"), n, F.lit(";")), F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")))
    shown = F.when(F.col("adjudicatari").rlike("(?i)detalle|adjudicaci"), "").otherwise(clean_awardee(plain))
    return rows.withColumns({"font": clean_source(F.col("font")), "adjudicatari": F.when(F.coalesce("adjudicatari", F.lit("")) == "", F.col("adjudicatari")).otherwise(shown)})


def master_order(position: str) -> list[Column]:
    """The order of the published list: latest, most relevant, largest first; missing values last, ties as they came."""
    return [F.coalesce("data_pub", F.lit("")).desc(), F.coalesce("rellevancia", F.lit(0)).desc(), F.coalesce("pressupost", F.lit(0.0)).desc(), F.col(position).asc()]


def resolver_candidates(candidates: DataFrame, attempted: DataFrame, position: str, limit: int, domains: Sequence[str] = (), ids: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Candidates (candidate_id, needs_resolver, extension, source_domain, position) to resolve next, and one row (considered, skipped_checkpoint, selected).

    Those that need it: said so, or leading to a gateway or nothing known; of the domains (as
    parts of names) and ids asked for, if any; not attempted before; the first ``limit`` by
    position. The counts look at all of them.
    """
    needs = F.coalesce("needs_resolver", F.lit(False)) | F.coalesce(F.col("extension").isin("gateway", ""), F.lit(False))
    domain = F.lower(F.coalesce("source_domain", F.lit("")))
    asked = F.lit(not domains)
    for d in domains:
        asked = asked | domain.contains(d.lower())
    asked = asked & (F.coalesce(F.col("candidate_id").isin(*ids), F.lit(False)) if ids else F.lit(True))
    done = attempted.select("candidate_id", F.lit(True).alias("_done")).distinct()
    rows = candidates.where(needs).join(done, "candidate_id", "left").withColumns({"_asked": asked, "_done": F.coalesce("_done", F.lit(False))})
    chosen = rows.where(F.col("_asked") & ~F.col("_done"))
    counts = rows.agg(F.count("*").alias("considered"), F.count_if(F.col("_asked") & F.col("_done")).alias("skipped_checkpoint"), F.least(F.count_if(F.col("_asked") & ~F.col("_done")), F.lit(limit)).alias("selected"))
    return chosen.drop("_asked", "_done").orderBy(position).limit(limit), counts


def consolidated(rows: DataFrame, ident: str, file: str, position: str) -> DataFrame:
    """rows of several files with ``duplicate``: an earlier file, or an earlier place in the file, has the row's id. Rows without an id are none."""
    place = F.struct(file, position)
    first = rows.where(truthy(F.col(ident)).isNotNull()).groupBy(ident).agg(F.min(place).alias("_first"))
    return rows.join(first, ident, "left").withColumn("duplicate", F.coalesce(place > F.col("_first"), F.lit(False))).drop("_first")


def lifecycle_counts(records: DataFrame) -> DataFrame:
    """One row: total, active_true, review_true, rs_count, clear_open, clear_awarded, unknown, no_lc."""
    category = F.coalesce("lifecycle_category", F.lit(""))
    one = lambda c: F.count_if(category == c)
    return records.agg(
        F.count("*").alias("total"), F.count_if(F.coalesce("active_opportunity_eligible", F.lit(False))).alias("active_true"), F.count_if(F.coalesce("lifecycle_review_required", F.lit(False))).alias("review_true"),
        one("OPEN_WITH_AWARD_EVIDENCE").alias("rs_count"), one("CLEAR_OPEN").alias("clear_open"), one("CLEAR_AWARDED").alias("clear_awarded"), one("UNKNOWN_LIFECYCLE").alias("unknown"), one("").alias("no_lc"),
    )
