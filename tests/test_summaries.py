"""Summaries of runs: ties, groups, empty tables, what a manifest states, samples and discards."""

from pyspark.sql import functions as F

from pliego.operators import gates as G
from pliego.operators import summaries as S


def tallied(spark, rows, **more):
    df = spark.createDataFrame(rows, "g string, pos int, a string, b boolean")
    return S.tally(df, {"rows": F.lit(True), "odd": F.col("b")}, {"a": F.col("a"), "pos": F.col("pos")}, **more)


def test_counts_histograms_and_top_lists(spark):
    rows = [("x", 5, "q", True), ("x", 1, "p", False), ("x", 2, "p", None), ("x", 3, "q", True), ("y", 4, None, True), ("x", 6, "r", False)]
    got = {(r["section"], r["measure"], r["value"], r["place"]): r["n"] for r in tallied(spark, rows, top={"a": 2}, position="pos").collect()}
    assert {k: n for k, n in got.items() if k[1] != "pos"} == {("count", "rows", None, None): 6, ("count", "odd", None, None): 3, ("top", "a", "p", 1): 2, ("top", "a", "q", 2): 2}
    assert len([k for k in got if k[1] == "pos"]) == 6
    groups = {(r["g"], r["value"], r["place"]) for r in tallied(spark, rows, top={"a": 1}, position="pos", keys=["g"]).where("measure = 'a'").collect()}
    assert groups == {("x", "p", 1)}


def test_empty_runs(spark):
    assert tallied(spark, []).count() == 0
    row = S.with_ratios(S.wide(tallied(spark, []), ["rows", "odd"]), {"share": ("odd", "rows")}).first()
    assert row.asDict() == {"rows": 0, "odd": 0, "share": 0.0}


def test_one_aggregation(spark):
    plan = tallied(spark, [("x", 1, "p", True)])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


LINK = "position int, title string, normalized_title string, kind string, extension string, source_domain string, confidence string, needs_resolver boolean, merge_ready boolean, fields array<string>"
RECORD = "kept int, before_filter int, error string, capped boolean, duplicates int, skipped map<string,bigint>"


def test_discovery_summary(spark):
    links = [(1, " Ver ", "", None, None, "a.es", None, None, None, None), (2, "Pliego", "", "pliego", "pdf", "a.es", "high", None, None, None), (3, "Aviso  Legal", "", "pliego", "pdf", None, "high", None, None, None)]
    records = [(2, 9, None, False, 1, {"nav": 2}), (1, 4, "x", True, None, None), (0, None, None, None, 3, {"nav": 1, "cap": 5})]
    long, row = S.link_summary(spark.createDataFrame(links, LINK), spark.createDataFrame(records, RECORD), ["aviso legal"])
    assert row.first().asDict() == {
        "records_attempted": 3, "records_with_candidates": 2, "candidates_before_filter": 13, "error_count": 1, "capped_records_count": 1, "duplicate_url_count": 4, "candidates_after_filter": 3, "generic_title_count": 1, "nav_title_count": 1,
        "error_rate": 0.333333, "records_with_candidates_ratio": 0.666667, "generic_title_ratio": 0.333333,
    }
    got = {(r["measure"], r["value"]): r["n"] for r in long.where("section <> 'count'").collect()}
    assert got[("skipped", "nav")] == 3 and got[("skipped", "cap")] == 5 and got[("confidence", "low")] == 1 and got[("kind", "unknown")] == 1 and got[("source_domain", "")] == 1 and got[("title", "Ver")] == 1


def test_gate_measures_feed_the_verdicts(spark):
    links = [(1, "Ver", "ver", "unknown", "gateway", "a", "low", None, True, ["k"]), (2, "P", "p", "pliego", "pdf", "a", "high", True, None, None)]
    records = spark.createDataFrame([(1, 1, None, False, 0, None), (1, 1, "x", False, 0, None)], RECORD)
    links = spark.createDataFrame(links, LINK)
    row = S.gate_measures(links, records, ["k"], ["p"])[1]
    m = row.first()
    assert (m["generic_title_count"], m["nav_like_survivor_count"], m["unresolved_gateway_count"], m["unknown_kind_ratio"], m["missing_v2_field_count"], m["merge_ready_false_count"], m["error_rate"]) == (1, 1, 2, 0.5, 1, 1, 0.5)
    assert G.quality_verdicts(row).first()["artifact_status"] == "FAIL"
    stated = spark.createDataFrame([(0, 7, 9)], "error_count long, generic_title_count long, nav_title_count long")
    s = S.gate_measures(links, records, ["k"], ["p"], stated)[1].first()
    assert (s["error_count"], s["error_rate"], s["generic_title_count"], s["nav_title_count"]) == (0, 0.0, 1, 9)
    assert S.gate_measures(links.limit(0), records.limit(0), ["k"], [])[1].first()["error_rate"] == 0.0


def test_discards_block_nothing_and_duplicates_follow_taken_ones(spark):
    rows = [(1, "e", None, "", None), (2, "e", "Obra", "", None), (3, "e", "Branding", "", None), (4, "e", "Branding y logotipo", "", None), (5, "e", "Branding", "", None), (6, "f", "Catering y branding", "", None), (7, "e", "", "", None)]
    df = S.discard_reasons(spark.createDataFrame(rows, "position int, ident string, title string, content string, cpv array<string>"), 20)
    assert [(r["position"], r["reason"], r["score"]) for r in df.orderBy("position").collect()] == [
        (1, "no_title", 0), (2, "title_gate", 0), (3, "low_score", 15), (4, None, 25), (5, "dup", 15), (6, "title_gate", 15), (7, "no_title", 0)
    ]
    long, evidence = S.discards(df, F.col("reason"), F.col("score"), "position", ["ident"], most=1)
    assert sorted((r["reason"], r["position"]) for r in evidence.collect()) == [("dup", 5), ("low_score", 3), ("no_title", 1), ("title_gate", 2)]
    got = {(r["measure"], r["value"]): r["n"] for r in long.collect()}
    assert got[("observed_entries_count", None)] == 7 and got[("candidate_id_count", None)] == 3 and got[("accepted_count", None)] == 1 and got[("low_score_by_score", "15")] == 1
