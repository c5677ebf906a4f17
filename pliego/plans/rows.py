"""Queries on events, conversations and embeddings' neighbours: windows, duplicates, statuses, JSON."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import dedup as D
from ..operators import evidence as E
from ..operators import gates as G
from ..operators import partition as S
from ..operators import privacy as X
from ..sources.tables import load
from .registry import query


@query("SELECT user_id, event_type, event_id, value, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, ts DESC, event_id DESC) = 1")
def canonical_pick(spark, sf_dir):
    """The best event of each user and type; ties go to the later one."""
    rows = load(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return D.best_of(rows, ["user_id", "event_type"], [F.col("value"), F.col("ts"), F.col("event_id")])


@query("""SELECT event_id, CASE WHEN event_id > coalesce(min(event_id) FILTER (value >= 50) OVER (PARTITION BY user_id), 9223372036854775807) THEN 'duplicate' WHEN value >= 50 THEN 'accepted' ELSE 'low_score' END AS outcome FROM events""")
def accepted_only_dup(spark, sf_dir):
    rows = load(spark, sf_dir, "events")
    dup = D.accepted_only_duplicates(rows, ["user_id"], "event_id", F.col("value") >= 50)
    return rows.select("event_id", F.when(dup, "duplicate").when(F.col("value") >= 50, "accepted").otherwise("low_score").alias("outcome"))


@query("""SELECT event_id, user_id, event_type, event_id = f AS first, lab AS first_label FROM (SELECT *, min(event_id) OVER w AS f, first_value(event_type) OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id) AS lab FROM events WINDOW w AS (PARTITION BY user_id, ts::DATE))""")
def first_accepted(spark, sf_dir):
    rows = load(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return D.first_accepted(rows, ["user_id", "day"], "event_id", "event_type").select("event_id", "user_id", "event_type", "first", "first_label")


@query("""WITH g AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS turn FROM events)
SELECT event_id, event_type, turn::INT AS turn FROM g""")
def round_robin(spark, sf_dir):
    """The turn of each event when types take turns by value."""
    rows = load(spark, sf_dir, "events").select("event_id", "event_type", (-F.col("value")).alias("v"))
    return D.round_robin(rows, ["event_type"], [F.col("v"), F.col("event_id")]).select("event_id", "event_type", "turn")


@query("SELECT event_id, user_id, value FROM events QUALIFY sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) <= 500")
def within_budget(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", "user_id", "value", "ts")
    return D.within_budget(rows, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("value"), 500).drop("ts")


@query("""WITH a AS (SELECT *, sum(CASE WHEN value < 20 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM events)
SELECT event_id, (sum(CASE WHEN value < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, isl ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS streak FROM a""")
def error_streaks(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", "user_id", "value", "ts")
    return D.error_streaks(rows, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("value") < 20).select("event_id", "streak")


@query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 3")
def stratified_sample(spark, sf_dir):
    return D.stratified(load(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", [F.col("event_id")], 3)


@query("""SELECT count(*) AS identities, count(*) FILTER (kind = 'id') AS by_id, count(*) FILTER (kind = 'url') AS by_url FROM (SELECT DISTINCT CASE WHEN event_type = 'purchase' THEN 'id' WHEN event_type <> 'click' THEN 'url' ELSE 'row' END AS kind,
  CASE WHEN event_type = 'purchase' THEN user_id::VARCHAR WHEN event_type <> 'click' THEN event_type || user_id ELSE event_id::VARCHAR END AS v FROM events)""")
def identity_count(spark, sf_dir):
    rows = load(spark, sf_dir, "events")
    ident = F.when(F.col("event_type") == "purchase", F.col("user_id").cast("string")).otherwise("")
    url = F.when(F.col("event_type") != "click", F.concat("event_type", F.col("user_id").cast("string"))).otherwise("")
    return A.identity_count(rows, ident, url, F.col("event_id"))


@query("SELECT k.key AS field, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events WHERE props IS NOT NULL) k GROUP BY 1")
def json_keys(spark, sf_dir):
    """How many events have each property, null ones included."""
    keys = load(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("field"))
    return keys.groupBy("field").agg(F.count("*").alias("n"))


@query("""SELECT key AS pointer, count(*) AS n, count(DISTINCT json_extract_string(props, '$."' || key || '"')) AS kinds FROM (SELECT props, unnest(json_keys(props)) AS key FROM events) GROUP BY 1""")
def json_leaves(spark, sf_dir):
    leaves = X.json_leaves(load(spark, sf_dir, "events"), "event_id", "props")
    return leaves.groupBy(F.substring("pointer", 2, 1000).alias("pointer")).agg(F.count("*").alias("n"), F.count_distinct("value").alias("kinds"))


@query("""SELECT s AS status, count(*) AS n FROM (SELECT CASE WHEN event_type = 'view' THEN 'SKIPPED_BY_GUARD' WHEN event_type = 'click' THEN CASE WHEN value >= 50 THEN 'MANUAL_DRY_RUN_SUCCESS' ELSE 'FAIL_CLOSED_VALIDATION' END
  WHEN value < 10 THEN 'FAIL_CLOSED_PARSER_NON_ATOM' WHEN value < 20 THEN 'FAIL_CLOSED_SHARD_BUILD' WHEN value < 30 THEN 'FAIL_CLOSED_GIT_PUSH' WHEN value < 60 THEN 'SUCCESS_REAL_FETCH_WRITE' ELSE 'SUCCESS_REAL_FETCH_NO_CHANGES' END AS s FROM events) GROUP BY 1""")
def operational_status(spark, sf_dir):
    """Events read as scheduled runs: their type and value say how the steps ended."""
    v, kind = F.col("value"), F.col("event_type")
    env = load(spark, sf_dir, "events").select(
        F.when(kind == "view", "skip").otherwise("run").alias("run_fetch"), F.when(kind == "click", "true").otherwise("false").alias("dry_run_mode"),
        F.when(v < 10, "failure").otherwise("success").alias("helper"), F.when(v >= 50, "success").otherwise("failure").alias("dryrun"),
        *(F.lit("success").alias(c) for c in ("validate", "diffsummary", "shardvalidate", "commit")), F.when(v < 20, "failure").otherwise("success").alias("shards"),
        F.when(v < 30, "failure").otherwise("success").alias("push"), F.when(v < 60, "true").otherwise("false").alias("data_changed"),
        F.when(v < 10, "refusing production write").otherwise("").alias("helper_log"), F.lit(False).alias("partial"), F.lit("FULL_SUCCESS").alias("run_status"), F.lit("non-atom answer").alias("source_errors"),
    )
    return env.groupBy(G.operational_status(env).alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, CASE WHEN a > 0 AND f = 0 THEN 'FULL_SUCCESS' WHEN a > 0 THEN 'PARTIAL_SUCCESS' WHEN f > 0 THEN 'EMPTY_FAILURE' ELSE 'EMPTY_SUCCESS' END AS status FROM
  (SELECT user_id, count(*) FILTER (value >= 50) AS a, count(*) FILTER (value < 5) AS f, count(*) AS n FROM events GROUP BY 1)""")
def run_status(spark, sf_dir):
    runs = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("value") >= 50).alias("a"), F.count_if(F.col("value") < 5).alias("f"), F.count("*").alias("n"))
    return runs.select("user_id", G.run_status(F.col("a"), F.col("f"), F.col("n")).alias("status"))


@query("""SELECT count(*) AS total, count(*) FILTER (value >= 20) AS resolved, count(*) FILTER (event_type = 'purchase') AS documents, count(*) FILTER (value < 5) AS errors,
  round(count(*) FILTER (value >= 20) / count(*), 6) AS resolved_ratio, round(count(*) FILTER (event_type = 'purchase') / count(*), 6) AS documents_ratio, round(count(*) FILTER (value < 5) / count(*), 6) AS errors_ratio FROM events""")
def resolver_summary(spark, sf_dir):
    return E.resolver_summary(load(spark, sf_dir, "events"), F.col("value") >= 20, F.col("event_type") == "purchase", F.col("value") < 5)


@query("""SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, min(turn) AS first_turn, sum(CASE WHEN role = p THEN 1 ELSE 0 END)::BIGINT AS repeats FROM
  (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) GROUP BY 1""")
def conversation_turns(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").withColumn("p", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_distinct("role").alias("roles"), F.min("turn").alias("first_turn"), F.sum(F.when(F.col("role") == F.col("p"), 1).otherwise(0)).alias("repeats"))


@query("SELECT conv_id, turn, substr(sha1_, 1, 16) AS cid, 'gen-' || '19980101T000000Z' || '-' || substr(sha_, 1, 12) AS gen FROM (SELECT conv_id, turn, sha1(conv_id || '|' || turn || '|' || text) AS sha1_, sha256(text) AS sha_ FROM conversations)")
def id_hash(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations")
    cid = S.candidate_id(F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("text"))
    return rows.select("conv_id", "turn", cid.alias("cid"), S.generation_id(F.lit("1998-01-01T00:00:00Z"), F.sha2("text", 256)).alias("gen"))


@query("""WITH r AS (SELECT user_id AS id, event_type AS key, event_id, value > 80 AS rich FROM events), i AS (SELECT id, count(*) AS n, min(event_id) AS o, count(*) FILTER (rich) AS nr, min(event_id) FILTER (rich) AS orich FROM r GROUP BY 1),
k AS (SELECT id, key, count(*) AS n, min(event_id) AS o FROM r GROUP BY 1, 2), q AS (SELECT c_custkey AS id, CASE WHEN c_acctbal > 5000 THEN 'purchase' ELSE 'view' END AS key FROM customer),
j AS (SELECT q.*, i.n AS n, i.o, i.nr, i.orich, k.n AS nk, k.o AS ok FROM q LEFT JOIN i USING (id) LEFT JOIN k USING (id, key))
SELECT id, key, CASE WHEN n IS NULL THEN 'unmatched' WHEN n = 1 THEN 'id' WHEN nk = 1 THEN 'id_and_key' WHEN nr = 1 THEN 'enriched_copy' ELSE 'ambiguous' END AS join_method,
  CASE WHEN n IS NULL THEN NULL WHEN n = 1 THEN o WHEN nk = 1 THEN ok WHEN nr = 1 THEN orich END AS record FROM j""")
def evidence_join(spark, sf_dir):
    """Customers matched to events by id, then id and key, then the one enriched copy."""
    records = load(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("key"), "event_id", (F.col("value") > 80).alias("rich"))
    rows = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 5000, "purchase").otherwise("view").alias("key"))
    return E.cascade_join(rows, records, "id", "key", "rich", "event_id")


@query("SELECT value AS url, count(DISTINCT user_id) AS ids FROM (SELECT event_type || '/' || floor(value)::INT AS value, user_id FROM events) GROUP BY 1 HAVING count(DISTINCT user_id) > 1")
def url_collisions(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select(F.concat_ws("/", "event_type", F.floor("value").cast("int").cast("string")).alias("url"), "user_id")
    return E.url_collisions(rows, "url", "user_id")
