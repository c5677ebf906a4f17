"""Persistence: targets, invariants and guards against direct versions, commits with two writers, appends."""

import random
from collections import Counter, defaultdict
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from pliego.operators import persistence as P
from pliego.sources import commits as C

ACCEPTED, RECORDS, EXISTING = "pos int, record_id string, canonical_key string, url string", "pos int, record_id string, canonical_key string, enriched boolean", "record_id string, url string"


def made(seed, clean=False):
    r = random.Random(seed)
    ids = [None, "", "a", "b", "c", "d", "zz"]
    records = [(k, r.choice(ids[:-1]), r.choice([None, "k1", "k2"]), r.choice([True, False, None])) for k in range(r.randint(0, 9))]
    existing = [(r.choice(ids), r.choice([None, "", "u1", "u2", "u3"])) for _ in range(r.randint(0, 6))]
    accepted = [(k, r.choice(ids), r.choice([None, "", "k1", "k2"]), r.choice([None, "", "u1", "u2", "u4", "u5"])) for k in range(r.randint(0, 8))]
    return accepted, records, existing


def target(nid, key, records):
    own = [x for x in records if x[1] and x[1] == nid]
    if not own:
        return None, "notice_id_not_found_in_production", False, False, "unknown"
    if len(own) == 1:
        return own[0][0], None, False, False, "single"
    keyed = [x for x in own if key and x[2] == key]
    if len(keyed) == 1:
        return keyed[0][0], None, True, not keyed[0][3], "enriched"
    rich = [x for x in own if x[3]]
    if len(rich) == 1:
        return rich[0][0], None, True, False, "enriched"
    return None, f"multiple_enriched_records_{len(rich)}" if rich else "no_enriched_record_in_group", True, False, "unknown"


def direct(accepted, records, existing):
    have, owners = {(i, u) for i, u in existing if i and u}, defaultdict(set)
    for i, u in have:
        owners[u].add(i)
    keys = {}
    for _, nid, key, _ in accepted:
        keys.setdefault(nid, key)
    targets = [target(nid, key, records) for nid, key in keys.items()]
    return {
        P.INVARIANTS[3]: len(accepted) - len({(i, u) for _, i, _, u in accepted}), P.INVARIANTS[4]: sum(not i or not u for _, i, _, u in accepted), P.INVARIANTS[5]: sum(bool(u) and (i, u) in have for _, i, _, u in accepted),
        P.INVARIANTS[6]: sum(bool(u) and bool(owners[u] - {i}) for _, i, _, u in accepted), P.INVARIANTS[7]: sum(t[1] is not None for t in targets), P.INVARIANTS[8]: sum(t[3] for t in targets),
    }


def tables(spark, seed):
    return [spark.createDataFrame(rows, ddl) for rows, ddl in zip(made(seed), (ACCEPTED, RECORDS, EXISTING))]


@pytest.mark.parametrize("seed", range(12))
def test_invariants_as_counted_directly(spark, seed):
    accepted, records, existing = tables(spark, seed)
    got = {r["rule"]: r for r in P.invariants(accepted, records, existing, P.MERGE_SCHEMA, False, "x", "x").collect()}
    want = direct(*made(seed))
    assert {k: r["violations"] for k, r in got.items()} == {k: want.get(k, 0) for k in P.INVARIANTS}
    assert all((r["status"] == "FAIL") == (r["violations"] > 0) and len(r["examples"]) <= 3 and bool(r["examples"]) == (r["violations"] > 0) for r in got.values())


@pytest.mark.parametrize("seed", range(12, 20))
def test_targets(spark, seed):
    accepted, records, _ = made(seed)
    wanted = [(i, k) for i in (None, "", "a", "b", "c", "zz") for k in (None, "k1", "k2")]
    got = P.selected_targets(spark.createDataFrame(wanted, "record_id string, canonical_key string"), spark.createDataFrame(records, RECORDS)).collect()
    want = [(i, t[0], t[4], t[2], t[3], t[1]) for i, k in wanted for t in [target(i, k, records)]]
    assert Counter(map(tuple, got)) == Counter(want)


def test_facts_and_verdict(spark):
    accepted, records, existing = (spark.createDataFrame(x, d) for x, d in (([(0, "a", "k", "u")], ACCEPTED), ([(0, "a", "k", True)], RECORDS), ([], EXISTING)))
    run = lambda *facts: P.verdict(P.invariants(accepted, records, existing, *facts)).first()
    assert tuple(run(P.MERGE_SCHEMA, False)) == (P.READY, []) and tuple(run(P.MERGE_SCHEMA, False, "d", "d")) == (P.READY, [])
    assert tuple(run("other", True, "d", "e")) == (P.HOLD, ["merge_plan_not_written", "merge_plan_schema", "production_sha_match"])
    assert P.verdict(P.invariants(accepted, records, existing, P.MERGE_SCHEMA, False).limit(0)).first()["verdict"] == P.HOLD


PLAN = "pos int, record_id string, target int, shared boolean, doc_record_id string, url string, title string"
GOOD = [(1, "a", 0, False, "a", "u1", "t1"), (2, "a", 0, False, "a", "u2", "t2"), (3, "b", 2, True, "b", "u3", None)]
OWN = [(0, "a", "k", False, [("u0", "old")]), (1, "b", "k1", False, None), (2, "b", "k2", True, None), (3, "c", "k", True, [])]
OWN_DDL = "pos int, record_id string, canonical_key string, enriched boolean, documents array<struct<url:string,title:string>>"
FACTS = {"schema": P.PLAN_SCHEMA, "verdict": P.READY, "written": False, "digest": "d", "expected": "d", "records_affected": 2, "total_new_docs": 3}


def guarded(spark, plan=GOOD, facts=FACTS):
    records = spark.createDataFrame(OWN, OWN_DDL)
    existing = records.select("record_id", F.explode("documents.url").alias("url"))
    return P.guards(spark.createDataFrame(plan, PLAN), records, existing, facts)


@pytest.mark.parametrize(
    ("change", "failed"),
    [
        ({}, []), ({"schema": "x"}, ["plan_schema"]), ({"verdict": P.HOLD}, ["plan_verdict"]), ({"written": None}, ["plan_not_written"]), ({"invariants_failed": ["a"]}, ["invariants_pass"]), ({"expected": "e"}, ["production_sha_match"]),
        ({"records_affected": 3}, ["records_affected"]), ({"total_new_docs": 2}, ["total_new_docs"]), ((1, "a", 9, False, "a", "u1", ""), ["target_exists"]), ((1, "a", 3, False, "a", "u1", ""), ["target_has_notice_id"]),
        ((3, "b", 1, True, "b", "u3", ""), ["target_not_placeholder"]), ((1, "a", 0, False, None, "u1", ""), ["docs_have_notice_id_and_url"]), ((1, "a", 0, False, "a", "", ""), ["docs_have_notice_id_and_url"]),
        ((1, "a", 0, False, "c", "u1", ""), ["docs_belong_to_record"]), ((1, "a", 0, False, "a", "u2", ""), ["docs_unique"]), ((1, "a", 0, False, "a", "u0", ""), ["url_not_on_record"]), ((3, "b", 2, True, "b", "u0", ""), ["url_not_on_other_record"]),
    ],
)
def test_each_guard(spark, change, failed):
    plan, facts = (GOOD, FACTS | change) if isinstance(change, dict) else ([change if change[0] == p[0] else p for p in GOOD], FACTS)
    rows = guarded(spark, plan, facts).orderBy("place").collect()
    assert [r["rule"] for r in rows] == list(P.GUARDS) and [r["rule"] for r in rows if r["status"] == "FAIL"] == failed


def test_plan_of_accepted_documents(spark):
    accepted = spark.createDataFrame([(0, "a", "k", "u0"), (1, "a", "k", "u1"), (2, "b", None, "u2"), (3, "zz", None, "u3"), (4, "c", None, "u0")], ACCEPTED)
    records = spark.createDataFrame(OWN, OWN_DDL)
    existing = records.select("record_id", F.explode("documents.url").alias("url"))
    plan = P.append_plan(accepted, records, existing)
    assert sorted((r["pos"], r["target"], r["kind"], r["shared"]) for r in plan.collect()) == [(1, 0, "single", False), (2, 2, "enriched", True), (4, 3, "single", False)]
    assert P.plan_counts(plan, accepted, records, existing).first().asDict() == {
        "records_affected": 3, "total_new_docs": 3, "records_already_have_docs": 1, "records_gaining_first_doc": 2, "existing_docs": 1, "docs_after": 4, "placeholder_targets": 0, "enriched_targets": 3,
        "same_record_url_collisions": 1, "cross_record_url_collisions": 1,
    }


@pytest.fixture
def table(spark, tmp_path):
    found = C.Commits(spark, str(tmp_path / "t"))
    assert found.current() == C.NOTHING and found.read() is None
    found.commit(spark.createDataFrame(OWN, OWN_DDL), C.NOTHING)
    return found


def test_planned_append(spark, table):
    first = table.current()
    version, summary = C.planned_append(table, first, spark.createDataFrame(GOOD, PLAN), guarded(spark), ["url", "title"])
    assert {r["pos"]: [tuple(d) for d in r["documents"] or []] for r in table.read().collect()} == {0: [("u0", "old"), ("u1", "t1"), ("u2", "t2")], 1: [], 2: [("u3", None)], 3: []}
    assert summary.first().asDict() == {
        "records_affected": 2, "records_already_had_docs": 1, "records_gaining_first_doc": 1, "records_before": 4, "docs_before": 1, "records_after": 4, "docs_after": 4, "urls_before": 1, "urls_after": 4,
        "duplicate_append_pairs": 0, "documents_appended": 3,
    }
    assert version.number == 1 and table.read(0).where("pos = 2").first()["documents"] is None and version.digest != first.digest


def folders(tmp_path):
    return sorted(p.name for p in (tmp_path / "t").iterdir())


def test_a_failing_guard_writes_nothing(spark, table, tmp_path):
    before, first = folders(tmp_path), table.current()
    with pytest.raises(C.Refused, match="guards: plan_schema"):
        C.planned_append(table, first, spark.createDataFrame(GOOD, PLAN), guarded(spark, facts=FACTS | {"schema": "x"}), ["url"])
    assert folders(tmp_path) == before and table.current() == first


def test_a_failing_check_leaves_no_folder(spark, table, tmp_path):
    before, first = folders(tmp_path), table.current()
    with pytest.raises(C.Refused, match="checks: all_documents_added"):
        C.planned_append(table, first, spark.createDataFrame([(*GOOD[0][:2], 77, *GOOD[0][3:])], PLAN), guarded(spark), ["url"])
    assert folders(tmp_path) == before and table.current() == first


def test_of_two_writers_one_is_refused(spark, table, tmp_path):
    pinned = table.current()
    rows = [table.read().withColumn("by", F.lit(k)) for k in range(4)]

    def write(k):
        try:
            return C.Commits(spark, table.path).commit(rows[k], pinned).number
        except C.Refused as e:
            return e.why

    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(write, range(4)))
    assert Counter(got)[1] == 1 and set(got) <= {1, "claim", "pin"}
    assert table.read().first()["by"] == got.index(1) and len([f for f in folders(tmp_path) if f.startswith("v")]) == 2
    with pytest.raises(C.Refused, match="pin: version 1"):
        table.commit(rows[0], pinned)


def test_a_version_comes_back(spark, table, tmp_path):
    first = table.current()
    second = table.commit(table.read().where("pos > 1"), first)
    third = table.restore(0, second)
    assert (third.number, third.digest, third.records) == (2, first.digest, 4) and table.read().count() == 4
    with pytest.raises(C.Refused, match="pin"):
        table.restore(0, second)
    assert C.swept(table, 1) == [second.folder] and table.read().count() == 4
    (tmp_path / "t" / "log" / "000000000003").write_bytes(b"")
    with pytest.raises(ValueError, match="has no content"):
        table.current()
