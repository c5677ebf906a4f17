"""Gates and status rules: ordered rules that give a verdict for a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAILED = ("failure", "cancelled")


def run_status(accepted: Column, failed_sources: Column, sources: Column) -> Column:
    """How a harvest ended."""
    return (
        F.when((accepted > 0) & (failed_sources == 0), "FULL_SUCCESS").when(accepted > 0, "PARTIAL_SUCCESS")
        .when(failed_sources > 0, "EMPTY_FAILURE").otherwise("EMPTY_SUCCESS")
    )


def refuses_write(partial: Column, status: Column) -> Column:
    """A partial run that does not call itself a success writes nothing."""
    return F.coalesce(partial, F.lit(False)) & ~F.lower(F.coalesce(status, F.lit(""))).contains("success")


def source_failure(errors: Column) -> Column:
    """The kind of a source failure, from its error texts."""
    return F.when(F.lower(F.coalesce(errors, F.lit(""))).contains("non-atom"), "FAIL_CLOSED_PARSER_NON_ATOM").otherwise("FAIL_CLOSED_PARTIAL_SOURCE_OUTAGE")


def failed_closed(partial: Column, status: Column) -> Column:
    """Whether a candidate counts as failed whatever its step reported."""
    return refuses_write(partial, status) | F.upper(F.coalesce(status, F.lit(""))).contains("FAILURE")


def operational_status(env: DataFrame) -> Column:
    """The status of a scheduled run from the outcomes of its steps; the first rule that fits counts.

    env has run_fetch, dry_run_mode, helper, dryrun, validate, diffsummary, shards,
    shardvalidate, commit, push, data_changed, helper_log, partial, run_status, source_errors.
    """
    c = lambda n: F.coalesce(env[n], F.lit("skipped"))
    bad = lambda n: c(n).isin(*FAILED)
    log, closed = F.lower(F.coalesce(env["helper_log"], F.lit(""))), refuses_write(env["partial"], env["run_status"])
    source = source_failure(F.concat_ws(" ", env["source_errors"], env["helper_log"]))
    changed = F.coalesce(env["data_changed"], F.lit(""))
    failed = (
        F.when(log.contains("lifecycle integrity failed"), "FAIL_CLOSED_MERGE_POLICY").when(log.contains("candidate invalid") | log.contains("production invalid"), "FAIL_CLOSED_VALIDATION")
        .when(log.contains("refusing production write") | log.contains("partial/failed candidate") | closed, source).otherwise("FAIL_CLOSED")
    )
    written = (
        F.when(bad("validate") | bad("diffsummary"), "FAIL_CLOSED_VALIDATION").when(bad("shards"), "FAIL_CLOSED_SHARD_BUILD").when(bad("shardvalidate"), "FAIL_CLOSED_PUBLIC_CONTRACT")
        .when(bad("commit"), "FAIL_CLOSED_GIT_COMMIT").when((changed == "true") & (c("push") != "success"), "FAIL_CLOSED_GIT_PUSH").when(changed == "true", "SUCCESS_REAL_FETCH_WRITE")
        .when(changed == "false", "SUCCESS_REAL_FETCH_NO_CHANGES").otherwise("UNKNOWN")
    )
    return (
        F.when(c("run_fetch") == "skip", "SKIPPED_BY_GUARD")
        .when(c("dry_run_mode") == "true", F.when(c("dryrun") == "success", "MANUAL_DRY_RUN_SUCCESS").otherwise("FAIL_CLOSED_VALIDATION"))
        .when(bad("helper"), failed).when(failed_closed(env["partial"], env["run_status"]), source).when(c("helper") == "success", written).otherwise("UNKNOWN")
    )


def threshold_gate(metrics: DataFrame, blocking: dict[str, Column], warning: dict[str, Column]) -> DataFrame:
    """metrics with blockers, warnings and verdict (PASS, WARN, FAIL) by named conditions."""
    named = lambda rules: F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items()))) if rules else F.array().cast("array<string>")
    out = metrics.withColumn("blockers", named(blocking)).withColumn("warnings", named(warning))
    return out.withColumn("verdict", F.when(F.size("blockers") > 0, "FAIL").when(F.size("warnings") > 0, "WARN").otherwise("PASS"))


def structural_signals(m: Column) -> Column:
    """Signals of a data set from its coverage struct (total, with_date, with_org, kinds, with_amount, no_kind, with_docs, with_place), all in percent."""
    from ..functions.semantics import pct

    p = lambda c: pct(m[c], m["total"])
    return F.array_compact(F.array(
        F.when(p("with_date") >= 90, "dates_covered"), F.when(p("with_org") >= 90, "organisations_covered"), F.when(m["kinds"] >= 6, "many_kinds"), F.when(p("with_amount") >= 50, "amounts_common"),
        F.when(p("no_kind") >= 25, "many_unclassified"), F.when(p("with_docs") < 50, "few_documents"), F.when(pct(m["total"] - m["with_place"], m["total"]) >= 20, "places_missing"),
        F.when(pct(m["total"] - m["with_amount"], m["total"]) >= 50, "amounts_missing"),
    ))


#: The limits of the artifact and merge verdicts.
LIMITS = {
    "artifact_error_rate": 0.05, "merge_error_rate": 0.01, "merge_generic_title_ratio": 0.10, "merge_unresolved_gateway_ratio": 0.10, "merge_nav_title_count": 0,
    "merge_unknown_kind_ratio": 0.05, "merge_resolver_error_rate": 0.01, "merge_resolved_document_ratio": 0.90,
}


def candidate_measures(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Measures of candidate links (record, title_generic, gateway, nav_title, nav_like, kind, fields_missing, merge_ready, error) by group, in one aggregation."""
    n = F.count("*")
    share = lambda c: F.round(F.count_if(F.coalesce(c, F.lit(False))) / n, 6)
    return candidates.groupBy(*keys).agg(
        n.alias("candidates_after_filter"), share(F.col("error")).alias("error_rate"), share(F.col("title_generic")).alias("generic_title_ratio"), share(F.col("gateway")).alias("unresolved_gateway_ratio"),
        F.count_if("nav_title").alias("nav_title_count"), F.count_if("nav_like").alias("nav_like_survivor_count"), share(F.col("kind") == "unknown").alias("unknown_kind_ratio"),
        F.count_if("fields_missing").alias("missing_v2_field_count"), F.count_if("merge_ready").alias("merge_ready_true_count"), F.count_distinct("record").alias("records_with_candidates"),
    )


def quality_verdicts(m: DataFrame, limits: dict[str, float] = LIMITS, resolver: bool = False) -> DataFrame:
    """Measures (candidate_measures, records_with_candidates_ratio) with artifact and merge verdicts.

    Adds artifact_status, artifact_blocking, artifact_warnings, merge_status, merge_blocking.
    With ``resolver`` the measures resolver_error_rate, resolved_document_ratio and
    merge_ready_candidate_count and unresolved_after_resolver_count count as well.
    """
    c, names = F.col, lambda rules: F.array_compact(F.array(*(F.when(r, F.lit(n)) for n, r in rules)))
    artifact = names([("error_rate", c("error_rate") > limits["artifact_error_rate"]), ("no_candidates", c("candidates_after_filter") == 0)])
    warnings = [
        ("missing_fields", c("missing_v2_field_count") > 0), ("generic_titles", c("generic_title_ratio") > 0.30), ("unresolved_gateways", c("unresolved_gateway_ratio") > 0.30),
        ("nav_like", c("nav_like_survivor_count") > 0), ("unknown_kinds", c("unknown_kind_ratio") > 0.10), ("few_records", c("records_with_candidates_ratio") < 0.50),
    ]
    blocking = [
        ("artifact", F.size("artifact_blocking") > 0), ("error_rate", c("error_rate") > limits["merge_error_rate"]), ("generic_titles", c("generic_title_ratio") > limits["merge_generic_title_ratio"]),
        ("unresolved_gateways", c("unresolved_gateway_ratio") > limits["merge_unresolved_gateway_ratio"]), ("nav_titles", c("nav_title_count") > limits["merge_nav_title_count"]), ("nav_like", c("nav_like_survivor_count") > 0),
        ("unknown_kinds", c("unknown_kind_ratio") > limits["merge_unknown_kind_ratio"]), ("missing_fields", c("missing_v2_field_count") > 0), ("none_ready", c("merge_ready_true_count") == 0),
    ]
    if resolver:
        blocking += [("resolver_errors", c("resolver_error_rate") > limits["merge_resolver_error_rate"]), ("few_resolved", c("resolved_document_ratio") < limits["merge_resolved_document_ratio"]), ("none_ready_after_resolver", c("merge_ready_candidate_count") == 0)]
        warnings += [("resolver_errors", c("resolver_error_rate") > 0), ("unresolved_after_resolver", c("unresolved_after_resolver_count") > 0)]
    out = m.withColumn("artifact_blocking", artifact).withColumn("artifact_warnings", names(warnings)).withColumn("merge_blocking", names(blocking))
    verdict = lambda x: F.when(F.size(x) == 0, "PASS").otherwise("FAIL")
    return out.withColumns({"artifact_status": verdict("artifact_blocking"), "merge_status": verdict("merge_blocking")})


def merge_gate(m: Column) -> Column:
    """struct(artifact, resolution, documents, write) of a run's measures: PASS, WARN or FAIL each; writing is never allowed.

    m has f2a_records, f2a_candidates, f2a_error_rate, resolver_error_rate,
    resolved_document_ratio, merge_ready_candidates, accepted, not_joined.
    """
    zero = lambda c: F.coalesce(m[c], F.lit(0))
    artifact = F.when((zero("f2a_records") <= 0) | (zero("f2a_candidates") <= 0) | (zero("f2a_error_rate") > 0.05), "FAIL").otherwise("PASS")
    resolution = F.when((zero("resolver_error_rate") > 0.05) | (zero("resolved_document_ratio") < 0.95) | (zero("merge_ready_candidates") <= 0), "FAIL").otherwise("PASS")
    documents = F.when((zero("accepted") == 0) | (resolution != "PASS"), "FAIL").when(zero("not_joined") > 0, "WARN").otherwise("PASS")
    return F.struct(artifact.alias("artifact"), resolution.alias("resolution"), documents.alias("documents"), F.lit("FAIL").alias("write"))


def production_validation(records: DataFrame, meta: DataFrame, schema: str, state: str) -> DataFrame:
    """One row: counts of a published data set, the issues found and the verdict PASS or FAIL.

    records has lifecycle_category and active_opportunity_eligible (null where absent); meta
    is one row with schema, publication_state, generation_id and dataset_sha256; without a
    row the schema is at issue.
    """
    active, category = F.coalesce("active_opportunity_eligible", F.lit(False)), F.col("lifecycle_category")
    counts = records.agg(
        F.count("*").alias("records"), F.count_if(active).alias("active"), F.count_if(F.coalesce(category, F.lit("")) == "").alias("missing_category"), F.count_if(F.col("active_opportunity_eligible").isNull()).alias("missing_active"),
        F.count_if(active & (category == "OPEN_WITH_AWARD_EVIDENCE")).alias("active_with_award"), F.count_if(active & (category == "CLEAR_AWARDED")).alias("active_awarded"),
    )
    own = F.coalesce(F.col("schema") == schema, F.lit(False))
    absent = lambda c: own & (F.coalesce(F.col(c), F.lit("")) == "")
    rules = [
        ("schema", ~own), ("publication_state", own & ~F.coalesce(F.col("publication_state") == state, F.lit(False))), ("generation_id", absent("generation_id")), ("dataset_sha256", absent("dataset_sha256")),
        ("missing_category", F.col("missing_category") > 0), ("missing_active", F.col("missing_active") > 0), ("active_with_award", F.col("active_with_award") > 0), ("active_awarded", F.col("active_awarded") > 0),
    ]
    issues = F.array_compact(F.array(*(F.when(r, F.lit(n)) for n, r in rules)))
    found = counts.join(F.broadcast(meta.limit(1)), F.lit(True), "left").withColumn("issues", issues)
    return found.withColumn("verdict", F.when(F.size("issues") == 0, "PASS").otherwise("FAIL")).drop(*meta.columns)


def shard_validation(source: DataFrame, shards: DataFrame, ident: str, year: str, years: tuple[int, ...], declared: int | None = None, needed: tuple[int, ...] = ()) -> DataFrame:
    """One row: whether shards (ident, year, shard) hold just the records of the source (some at least), by count, by multiset of ids, and an archive without listed years."""
    from .aggregates import multiset_difference

    sizes = source.agg(F.count("*").alias("source_records")).crossJoin(shards.agg(F.count("*").alias("sharded_records"), F.count_if((F.col("shard") == "archive") & F.col(year).isin(*years)).alias("archive_in_range")))
    differ = multiset_difference(source, shards, ident).agg(F.count("*").alias("ids_changed"))
    rules = [
        ("record_count", F.col("source_records") != F.col("sharded_records")), ("ids_changed", F.col("ids_changed") > 0), ("archive_in_range", F.col("archive_in_range") > 0),
        ("no_records", F.col("source_records") == 0), ("year_missing", F.lit(not set(needed) <= set(years))), ("declared_count", F.lit(declared).cast("long").isNotNull() & (F.lit(declared).cast("long") != F.col("source_records"))),
    ]
    found = sizes.crossJoin(differ).withColumn("issues", F.array_compact(F.array(*(F.when(r, F.lit(n)) for n, r in rules))))
    return found.withColumn("verdict", F.when(F.size("issues") == 0, "PASS").otherwise("FAIL"))


def source_coverage(runs: DataFrame) -> DataFrame:
    """(source, status, retrieved_at): each requested source of runs (requested, completed, failed, generated_at).

    failed before ok before degraded; only a source that is ok has a time of retrieval.
    Without requested sources the completed ones count.
    """
    none = F.array().cast("array<string>")
    asked = F.when(F.size(F.coalesce("requested", none)) > 0, F.col("requested")).otherwise(F.coalesce("completed", none))
    rows = runs.select(F.explode(asked).alias("source"), F.coalesce("completed", none).alias("completed"), F.coalesce("failed", none).alias("failed"), "generated_at")
    status = F.when(F.array_contains("failed", F.col("source")), "failed").when(F.array_contains("completed", F.col("source")), "ok").otherwise("degraded")
    return rows.select("source", status.alias("status"), F.when(status == "ok", F.col("generated_at")).alias("retrieved_at"))


def freshness(coverage: DataFrame) -> DataFrame:
    """(retrieved_at, publishable): the latest retrieval of a source that is ok; without any, nothing may be published."""
    return coverage.agg(F.max("retrieved_at").alias("retrieved_at")).withColumn("publishable", F.col("retrieved_at").isNotNull())


def appendix_status(has_text: Column, role: Column, present: Column, deferred: Column) -> Column:
    """ready, partial or insufficient_text of a notice by the names of its fields that have a value.

    Subject, codes and one of value, budget, duration and criteria make a notice ready,
    unless a field is deferred to another document.
    """
    has = lambda *names: F.arrays_overlap(present, F.array(*map(F.lit, names)))
    core = has("objeto") & has("cpv") & has("valor_estimado", "presupuesto_base", "duracion", "criterios_adjudicacion")
    some = has("objeto", "cpv", "valor_estimado", "presupuesto_base", "duracion", "criterios_adjudicacion")
    return F.when(~has_text | (role != "anuncio_placsp"), "insufficient_text").when(core & ~deferred, "ready").when(some, "partial").otherwise("insufficient_text")


def enforced(value: Column, status: Column, confidence: Column, evidence: Column, floor: str, strict: bool) -> Column:
    """struct(value, status) of a field after the floor of confidence and, if strict, the demand for evidence."""
    rank = lambda c: F.create_map(F.lit("low"), F.lit(0), F.lit("medium"), F.lit(1), F.lit("high"), F.lit(2))[c]
    claimed = value.isNotNull() & status.isin("extracted", "partial")
    bare = claimed & F.lit(strict) & (F.coalesce(evidence, F.lit("")) == "")
    weak = claimed & F.coalesce(rank(confidence) < rank(F.lit(floor)), F.lit(False))
    return F.struct(F.when(~F.coalesce(bare | weak, F.lit(False)), value).alias("value"), F.when(bare, "insufficient_evidence").when(weak, "below_min_confidence").otherwise(status).alias("status"))


def known_labels(existing: Column, proposed: Column, known: tuple[str, ...]) -> Column:
    """The sorted union of labels; a proposal with an unknown label leaves the existing ones."""
    unknown = F.exists(proposed, lambda d: ~d.isin(*known))
    return F.when(F.coalesce(unknown, F.lit(False)), existing).otherwise(F.array_sort(F.array_union(F.coalesce(existing, F.array().cast("array<string>")), F.coalesce(proposed, F.array().cast("array<string>")))))


def structure_issues(envelope: Column) -> Column:
    """What keeps a JSON text from being a data set: no object, no list under data, no object under meta."""
    kind = lambda path: F.schema_of_variant(F.try_variant_get(F.try_parse_json(envelope), path, "variant"))
    whole = F.coalesce(kind("$").startswith("OBJECT"), F.lit(False))
    return F.array_compact(F.array(
        F.when(~whole, "not_an_object"), F.when(whole & ~F.coalesce(kind("$.data").startswith("ARRAY"), F.lit(False)), "no_data_list"), F.when(whole & ~F.coalesce(kind("$.meta").startswith("OBJECT"), F.lit(False)), "no_meta"),
    ))


def input_problems(meta: DataFrame, documents: DataFrame, schema: str) -> DataFrame:
    """(rule, n, problem): what is wrong with a manifest before its documents are read; no rows if nothing is.

    meta is one row (schema, production_write_performed, has_records); documents
    (extraction_status, text, display_role, display_label, matched_url). Without a row of meta
    its rules fail.
    """
    m = meta.groupBy().agg(F.first("schema").alias("schema"), F.first("production_write_performed").alias("written"), F.first("has_records").alias("records"))
    d = documents.agg(
        F.count_if((F.col("extraction_status") == "extracted") & (F.coalesce("text", F.lit("")) == "")).alias("missing_text"),
        F.count_if(~F.coalesce("display_role", F.lit("unknown")).isin("unknown") & (F.col("display_label") == "Documento pdf")).alias("generic_label"),
        F.count_if(F.col("matched_url").isNotNull() & ~F.startswith("matched_url", F.lit("http"))).alias("invented_url"),
    )
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    rule = lambda name, n, said: F.struct(F.lit(name).alias("rule"), n.cast("long").alias("n"), said.alias("problem"))
    wrong = lambda c: F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1)
    rules = F.array(
        rule("schema", wrong(F.col("schema") == schema), F.concat(F.lit("input schema is "), text("schema"), F.lit(f", expected {schema}"))),
        rule("written", wrong(~F.col("written")), F.concat(F.lit("production_write_performed is "), text("written"))), rule("records", wrong(F.col("records")), F.lit("input has no list of records")),
        rule("missing_text", F.col("missing_text"), F.concat(text("missing_text"), F.lit(" extracted document(s) have no readable text"))), rule("generic_label", F.col("generic_label"), F.lit("a classified document has the generic label")),
        rule("invented_url", F.col("invented_url"), F.lit("a matched address is none")),
    )
    return m.crossJoin(d).select(F.explode(F.filter(rules, lambda x: x["n"] > 0)).alias("r")).select("r.*")  # one row each
