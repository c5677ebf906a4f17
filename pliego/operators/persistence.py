"""Appending documents to records: the record of each, invariants and guards as rows, the append itself.

A plan is a table of documents (pos, record_id, canonical_key, url, ...); production is
a table of records (pos, record_id, canonical_key, enriched, ...) and one of the documents
that they have (record_id, url). Each rule is a row (rule, status, violations, reason,
examples): violations are counted over everything, examples are the first few.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import top_n

EXAMPLES = 3
READY, APPLIED, HOLD = "PERSISTENCE_DRY_RUN_READY", "APPLY_COMPLETED", "HOLD"
MERGE_SCHEMA, PLAN_SCHEMA = "f2merge/3", "f2persist/1"

INVARIANTS = (
    "production_sha_match", "merge_plan_schema", "merge_plan_not_written", "accepted_docs_unique_by_notice_id_url", "accepted_docs_have_notice_id_and_url", "no_same_record_url_collision",
    "no_cross_record_url_collision", "target_notice_id_resolves_to_one_record", "no_placeholder_append_target", "docs_in_sidecar_only", "production_write_performed_false",
)
GUARDS = (
    "plan_schema", "plan_verdict", "plan_not_written", "invariants_pass", "production_sha_match", "records_affected", "total_new_docs", "target_exists", "target_has_notice_id", "target_not_placeholder",
    "docs_have_notice_id_and_url", "docs_belong_to_record", "docs_unique", "url_not_on_record", "url_not_on_other_record",
)


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) == ""


def selected_targets(wanted: DataFrame, records: DataFrame) -> DataFrame:
    """(record_id, target, kind, shared, placeholder, error) for wanted (record_id, canonical_key), each id once.

    The only record of the id; else the one of the key; else the only enriched one. target is
    its pos; shared says that several records have the id, placeholder that the target
    is none of the enriched ones among them.
    """
    rich = F.coalesce("enriched", F.lit(False))
    records = records.where(~_blank("record_id"))
    by_id = records.groupBy("record_id").agg(F.count("*").alias("n"), F.min("pos").alias("one"), F.count_if(rich).alias("n_rich"), F.min(F.when(rich, F.col("pos"))).alias("rich"))
    by_key = records.where(~_blank("canonical_key")).groupBy("record_id", "canonical_key").agg(F.count("*").alias("n_key"), F.min("pos").alias("key_pos"), F.max(rich).alias("key_rich"))
    j = wanted.join(by_id, "record_id", "left").join(by_key, ["record_id", "canonical_key"], "left")
    single, keyed, copy = F.col("n") == 1, F.coalesce(F.col("n_key") == 1, F.lit(False)), F.col("n_rich") == 1
    error = (
        F.when(F.col("n").isNull(), "notice_id_not_found_in_production").when(single | keyed | copy, None).when(F.col("n_rich") == 0, "no_enriched_record_in_group")
        .otherwise(F.concat(F.lit("multiple_enriched_records_"), F.col("n_rich").cast("string")))
    )
    target = F.when(single, F.col("one")).when(keyed, F.col("key_pos")).when(copy, F.col("rich"))
    return j.select(
        "record_id", target.alias("target"), F.when(single, "single").when(error.isNull(), "enriched").otherwise("unknown").alias("kind"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("shared"),
        (error.isNull() & (F.col("n") > 1) & keyed & ~F.coalesce("key_rich", F.lit(False))).alias("placeholder"), error.alias("error"),
    )


def _wanted(accepted: DataFrame) -> DataFrame:
    """Each record id of a plan with the key of its first document."""
    return accepted.groupBy("record_id").agg(F.min_by("canonical_key", "pos").alias("canonical_key"))


def _collisions(pairs: DataFrame, existing: DataFrame) -> DataFrame:
    """pairs (record_id, url, ...) with on_record and on_other: the URL is one of the record's documents, or of another's."""
    have = existing.where(~_blank("record_id") & ~_blank("url"))
    own = have.select("record_id", "url").distinct().withColumn("_own", F.lit(True))
    held = have.groupBy("url").agg(F.min("record_id").alias("_least"), F.max("record_id").alias("_most"))
    j = pairs.join(own, ["record_id", "url"], "left").join(held, "url", "left")
    other = F.col("_least").isNotNull() & (~F.col("_least").eqNullSafe(F.col("record_id")) | ~F.col("_most").eqNullSafe(F.col("record_id")))
    return j.withColumns({"on_record": F.coalesce("_own", F.lit(False)), "on_other": other}).drop("_own", "_least", "_most")


def _found(rows: DataFrame, rules: Mapping[str, Column], detail: Column, order: Sequence[Column]) -> DataFrame:
    """(rule, violations, examples) of rows, for rules that give the number of a row's violations; one scan for all of them."""
    flagged = F.filter(F.array(*(F.struct(F.lit(r).alias("rule"), c.cast("long").alias("n")) for r, c in rules.items())), lambda x: x["n"] > 0)
    long = rows.select(F.explode(flagged).alias("f"), detail.cast("string").alias("example"), *(c.alias(f"_o{i}") for i, c in enumerate(order))).select("f.*", "example", *(f"_o{i}" for i in range(len(order))))
    few = top_n(long, ["rule"], [F.asc_nulls_first(f"_o{i}") for i in range(len(order))], EXAMPLES).groupBy("rule").agg(F.array_sort(F.collect_list("example")).alias("examples"))
    return long.groupBy("rule").agg(F.sum("n").alias("violations")).join(few, "rule", "left")


def _facts(spark, facts: Mapping[str, tuple[bool, str]]) -> DataFrame:
    """(rule, violations, examples) of rules that look at no rows."""
    return spark.createDataFrame([(r, 0 if ok else 1, [] if ok else [why]) for r, (ok, why) in facts.items()], "rule string, violations long, examples array<string>")


def _rows(names: Sequence[str], *found: DataFrame) -> DataFrame:
    """(place, rule, status, violations, examples), one row for each name in order."""
    spark = found[0].sparkSession
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    base = spark.createDataFrame(list(enumerate(names)), "place int, rule string")
    n = F.coalesce("violations", F.lit(0))
    return base.join(every, "rule", "left").select("place", "rule", F.when(n == 0, "PASS").otherwise("FAIL").alias("status"), n.alias("violations"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def _pair(*names: str) -> Column:
    return F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in names))


def invariants(accepted: DataFrame, records: DataFrame, existing: DataFrame, schema: str, written: bool, digest: str = "", expected: str | None = None) -> DataFrame:
    """The eleven invariants of a merge plan (accepted documents) over production; ``expected`` None leaves the digest untested.

    Documents are grouped by (record_id, url) first, so repeats are counted, not joined. The
    last two rules hold by construction: nothing here writes.
    """
    pairs = accepted.groupBy("record_id", "url").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    lacking = _blank("record_id") | _blank("url")
    n = F.col("n")
    rows = _found(
        _collisions(pairs, existing),
        {
            INVARIANTS[3]: n - 1, INVARIANTS[4]: F.when(lacking, n).otherwise(0), INVARIANTS[5]: F.when(F.col("on_record") & ~_blank("url"), n).otherwise(0),
            INVARIANTS[6]: F.when(F.col("on_other") & ~_blank("url"), n).otherwise(0),
        },
        _pair("record_id", "url"), [F.col("record_id"), F.col("url")],
    )
    targets = _found(selected_targets(_wanted(accepted), records), {INVARIANTS[7]: F.col("error").isNotNull(), INVARIANTS[8]: F.col("placeholder")}, _pair("record_id", "error"), [F.col("record_id")])
    facts = {
        INVARIANTS[0]: (expected is None or digest == expected, f"expected={expected} got={digest}"), INVARIANTS[1]: (schema == MERGE_SCHEMA, f"schema={schema}"),
        INVARIANTS[2]: (written is False, f"production_write_performed={written}"), INVARIANTS[9]: (True, ""), INVARIANTS[10]: (True, ""),
    }
    return _rows(INVARIANTS, _facts(accepted.sparkSession, facts), rows, targets)


def verdict(rules: DataFrame, ready: str = READY) -> DataFrame:
    """One row: (verdict, failed), with the names of the rules that fail; no rules are no leave to write."""
    failed = F.array_sort(F.collect_list(F.when(F.col("status") != "PASS", F.col("rule"))))
    out = rules.agg(F.count("*").alias("n"), failed.alias("failed"))
    return out.select(F.when((F.col("n") > 0) & (F.size("failed") == 0), ready).otherwise(HOLD).alias("verdict"), "failed")


def append_plan(accepted: DataFrame, records: DataFrame, existing: DataFrame) -> DataFrame:
    """accepted with target, kind, shared: documents that a record has already and those without a target are left out."""
    targets = selected_targets(_wanted(accepted), records).where("error IS NULL").drop("placeholder", "error")
    open_ = accepted.join(existing.where(~_blank("url")).select("record_id", "url").distinct(), ["record_id", "url"], "left_anti")
    return open_.join(targets, "record_id")


def plan_counts(plan: DataFrame, accepted: DataFrame, records: DataFrame, existing: DataFrame) -> DataFrame:
    """One row of a plan's counts: records, new documents, records with documents or without, collisions, kinds of targets."""
    have = existing.where(~_blank("record_id") & ~_blank("url")).groupBy("record_id").agg(F.count_distinct("url").alias("had"))
    targets = selected_targets(_wanted(accepted), records).where("error IS NULL")
    new = plan.groupBy("record_id").agg(F.count("*").alias("new"))
    rows = targets.join(have, "record_id", "left").join(new, "record_id", "left")
    had, added = F.coalesce("had", F.lit(0)), F.coalesce("new", F.lit(0))
    clash = _collisions(accepted.select("record_id", "url"), existing).agg(F.count_if("on_record").alias("same_record_url_collisions"), F.count_if(F.col("on_other") & ~F.col("on_record")).alias("cross_record_url_collisions"))
    sums = rows.agg(
        F.count("*").alias("records_affected"), F.coalesce(F.sum(added), F.lit(0)).alias("total_new_docs"), F.count_if(had > 0).alias("records_already_have_docs"), F.count_if(had == 0).alias("records_gaining_first_doc"),
        F.coalesce(F.sum(had), F.lit(0)).alias("existing_docs"), F.coalesce(F.sum(had + added), F.lit(0)).alias("docs_after"), F.count_if("placeholder").alias("placeholder_targets"), F.count_if(~F.col("placeholder")).alias("enriched_targets"),
    )
    return sums.crossJoin(clash)  # one row each


def guards(plan: DataFrame, records: DataFrame, existing: DataFrame, facts: Mapping[str, object]) -> DataFrame:
    """The guards of a plan (pos, record_id, target, shared, doc_record_id, url) before anything is written.

    facts: schema, verdict, written, invariants_failed (names), digest, expected,
    records_affected and total_new_docs, as the plan states them. target is the pos of a record.
    """
    at = records.select(F.col("pos").alias("target"), F.col("record_id").alias("_id"), F.coalesce("enriched", F.lit(False)).alias("_rich"))
    targets = plan.select("record_id", "target", "shared").distinct().join(at, "target", "left")
    exists = F.col("_id").isNotNull()
    of_targets = _found(
        targets,
        {
            GUARDS[7]: ~exists, GUARDS[8]: exists & ~F.col("_id").eqNullSafe(F.col("record_id")), GUARDS[9]: exists & F.coalesce("shared", F.lit(False)) & ~F.col("_rich"),
        },
        _pair("record_id", "target"), [F.col("record_id"), F.col("target")],
    )
    whole = ~_blank("doc_record_id") & ~_blank("url")
    docs = plan.groupBy("record_id", "url", "doc_record_id").agg(F.count("*").alias("n"))
    pairs = docs.where(whole).groupBy("record_id", "url").agg(F.sum("n").alias("n"))
    of_docs = _found(
        docs, {GUARDS[10]: F.when(~whole, F.col("n")).otherwise(0), GUARDS[11]: F.when(whole & ~F.col("doc_record_id").eqNullSafe(F.col("record_id")), F.col("n")).otherwise(0)},
        _pair("record_id", "doc_record_id", "url"), [F.col("record_id"), F.col("url")],
    )
    of_pairs = _found(
        _collisions(pairs, existing), {GUARDS[12]: F.col("n") - 1, GUARDS[13]: F.when(F.col("on_record"), F.col("n")).otherwise(0), GUARDS[14]: F.when(F.col("on_other"), F.col("n")).otherwise(0)},
        _pair("record_id", "url"), [F.col("record_id"), F.col("url")],
    )
    stated = plan.agg(F.count_distinct("record_id").alias("r"), F.count("*").alias("d"))
    counts = [("records_affected", "r"), ("total_new_docs", "d")]
    of_counts = _found(stated, {g: F.col(c) != F.lit(facts.get(g, -1)) for g, c in counts}, F.concat_ws(" ", F.lit("plan has"), "r", F.lit("records and"), "d", F.lit("documents")), [F.col("r")])
    failed = list(facts.get("invariants_failed", ()))
    told = {
        GUARDS[0]: (facts.get("schema") == PLAN_SCHEMA, f"schema={facts.get('schema')}"), GUARDS[1]: (facts.get("verdict") == READY, f"verdict={facts.get('verdict')}"),
        GUARDS[2]: (facts.get("written") is False, f"production_write_performed={facts.get('written')}"), GUARDS[3]: (not failed, f"invariants not PASS: {failed}"),
        GUARDS[4]: (facts.get("digest") == facts.get("expected"), f"expected={facts.get('expected')} got={facts.get('digest')}"),
    }
    return _rows(GUARDS, _facts(plan.sparkSession, told), of_counts, of_targets, of_docs, of_pairs)


def appended(records: DataFrame, plan: DataFrame, document: Sequence[str], documents: str = "documents") -> DataFrame:
    """records whose list of documents ends with those of the plan, in its order; a record without a list gets one if it has new documents."""
    new = plan.groupBy(F.col("target").alias("pos")).agg(F.sort_array(F.collect_list(F.struct("pos", *document))).alias("_new"))
    item = records.schema[documents].dataType.elementType  # type: ignore[attr-defined]
    have = [f.name for f in item.fields]
    shaped = F.transform("_new", lambda d: F.struct(*((d[c] if c in document else F.lit(None)).cast(item[c].dataType).alias(c) for c in have)))
    before = F.coalesce(documents, F.array().cast(records.schema[documents].dataType))
    return records.join(new, "pos", "left").withColumn(documents, F.when(F.col("_new").isNotNull(), F.concat(before, shaped)).otherwise(F.col(documents))).select(*records.columns)


def apply_summary(before: DataFrame, after: DataFrame, plan: DataFrame, documents: str = "documents") -> DataFrame:
    """One row: records and document URLs before and after, documents added, records that had some and that gain their first, pairs added twice."""
    urls = lambda df, name: df.select("record_id", F.explode(documents).alias("d")).where("d.url <> '' AND record_id IS NOT NULL").agg(F.count_distinct("record_id", "d.url").alias(name))
    counts = lambda df, name: df.agg(F.count("*").alias(f"records_{name}"), F.coalesce(F.sum(F.coalesce(F.size(F.coalesce(documents, F.array().cast(df.schema[documents].dataType))), F.lit(0))), F.lit(0)).alias(f"docs_{name}"))
    touched = plan.select(F.col("target").alias("pos")).distinct().join(before.select("pos", F.coalesce(F.size(F.coalesce(documents, F.array().cast(before.schema[documents].dataType))), F.lit(0)).alias("had")), "pos")
    had = touched.agg(F.count("*").alias("records_affected"), F.count_if(F.col("had") > 0).alias("records_already_had_docs"), F.count_if(F.col("had") == 0).alias("records_gaining_first_doc"))
    twice = plan.groupBy("record_id", "url").count().agg(F.count_if(F.col("count") > 1).alias("duplicate_append_pairs"))
    out = had
    for one in (counts(before, "before"), counts(after, "after"), urls(before, "urls_before"), urls(after, "urls_after"), twice):
        out = out.crossJoin(one)  # one row each
    return out.withColumn("documents_appended", F.col("docs_after") - F.col("docs_before"))
