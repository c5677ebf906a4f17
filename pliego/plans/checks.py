"""Queries on views and gates: parametrised filters and pages, verdicts, validations, targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import notices as N
from ..operators import gates as G
from ..operators import targeting as T
from ..operators import views as V
from ..sources.tables import load
from .orders import AS_OF, CODE, NOTICES, notices
from .registry import query

_DAYS = "(data_pub - DATE '1998-01-01')"
_SHOWN = NOTICES + f""", v AS (SELECT *, CASE raw WHEN 'O' THEN CASE WHEN {_DAYS} >= 0 THEN 'open' ELSE 'expired' END WHEN 'P' THEN 'ev' ELSE 'adjudicado' END AS display FROM notices)"""


def _view(spark, sf_dir):
    """Notices with the columns that a table view has; the date stands for the deadline."""
    rows = notices(spark, sf_dir).withColumns({
        "data_pub": F.col("data_pub").cast("string"), "data_limit": F.col("data_pub").cast("string"), "estat_raw": N.mapped(CODE, F.col("raw")), "titol": F.col("kind"), "kw": F.array("kind"),
        "disciplines": F.when(F.col("kind") == "5-LOW", F.array().cast("array<string>")).otherwise(F.array("kind")), "adjudicatari": F.lit(""), "active": F.col("raw") == "O",
    })
    return V.with_display(rows, AS_OF)


@query(_SHOWN + """, f AS (SELECT * FROM v WHERE raw = 'O' AND (kind = '5-LOW' OR kind = '1-URGENT') AND (contains(lower(kind), 'u') OR contains(lower(organisme), 'u'))),
o AS (SELECT id, display, pressupost, row_number() OVER (ORDER BY display = 'open' DESC, pressupost DESC, id) AS r, count(*) OVER () AS total FROM f)
SELECT id, display, pressupost, 3 AS page, ((total + 19) // 20)::INT AS pages, total FROM o WHERE r > 40 AND r <= 60""")
def filtered_page(spark, sf_dir):
    """The third page of active notices by text, and by discipline or the lack of one."""
    f = V.Filters(active_only=True, disciplines=(V.NO_DISCIPLINE, "1-URGENT"), query="U")
    return V.page(V.filtered(_view(spark, sf_dir), f, AS_OF), 3, 20, "pressupost", descending=True).select("id", "display", "pressupost", "page", "pages", "total")


@query(_SHOWN + """, p AS (SELECT max(year(data_pub) * 3 + (month(data_pub) - 1) // 4) AS i FROM notices WHERE estat = 'Vigente' AND year(data_pub) = 1997)
SELECT ccaa, count(*) AS n FROM notices, p WHERE estat = 'Vigente' AND year(data_pub) * 3 + (month(data_pub) - 1) // 4 = i GROUP BY 1""")
def period_panel(spark, sf_dir):
    """Open notices of the last period of 1997 that has any, by territory."""
    base = V.panel_base(_view(spark, sf_dir), V.Filters(status="Vigente"))
    year, third = V.resolved_period(base, year=1997).first()
    return V.period_rows(base, year, third).groupBy("ccaa").agg(F.count("*").alias("n"))


@query(_SHOWN + f"SELECT count(*) AS total, count(*) FILTER (display = 'open') AS open, count(*) FILTER (raw = 'O') AS active, count(*) FILTER ({_DAYS} > -3) AS fresh FROM v")
def view_activity(spark, sf_dir):
    return V.activity(_view(spark, sf_dir), AS_OF)


@query("SELECT o_orderkey AS id, count(*) OVER (PARTITION BY o_custkey) AS states FROM orders")
def record_states(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    return V.with_states(rows, "o_custkey").select("id", "states")


@query("SELECT min(year(o_orderdate))::VARCHAR AS first, max(year(o_orderdate))::VARCHAR AS last FROM orders")
def year_range(spark, sf_dir):
    return V.year_range(load(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("data_pub")))


_MEASURES = """WITH m AS (SELECT event_type, count(*) AS n, round(count(*) FILTER (value < 2) / count(*), 6) AS er, round(count(*) FILTER (value < 12) / count(*), 6) AS gt, round(count(*) FILTER (value > 93) / count(*), 6) AS ug,
  count(*) FILTER (value > 99.9) AS nt, round(count(*) FILTER (value BETWEEN 40 AND 44) / count(*), 6) AS uk, count(*) FILTER (value > 98) AS mr FROM events GROUP BY 1)"""


@query(_MEASURES + """SELECT event_type, CASE WHEN er > 0.05 THEN 'FAIL' ELSE 'PASS' END AS artifact, concat_ws(',', CASE WHEN er > 0.05 THEN 'artifact' END, CASE WHEN er > 0.01 THEN 'error_rate' END, CASE WHEN gt > 0.1 THEN 'generic_titles' END,
  CASE WHEN ug > 0.1 THEN 'unresolved_gateways' END, CASE WHEN nt > 0 THEN 'nav_titles' END, CASE WHEN uk > 0.05 THEN 'unknown_kinds' END, CASE WHEN mr = 0 THEN 'none_ready' END) AS blocking FROM m""")
def candidate_verdicts(spark, sf_dir):
    """Events read as candidate links: measures by type, and the artifact and merge verdicts on them."""
    v = F.col("value")
    rows = load(spark, sf_dir, "events").select(
        "event_type", F.col("user_id").alias("record"), (v < 12).alias("title_generic"), (v > 93).alias("gateway"), (v > 99.9).alias("nav_title"), F.lit(False).alias("nav_like"),
        F.when(v.between(40, 44), "unknown").otherwise("annex").alias("kind"), F.lit(False).alias("fields_missing"), (v > 98).alias("merge_ready"), (v < 2).alias("error"),
    )
    m = G.candidate_measures(rows, ["event_type"]).withColumn("records_with_candidates_ratio", F.lit(1.0))
    return G.quality_verdicts(m).select("event_type", F.col("artifact_status").alias("artifact"), F.array_join("merge_blocking", ",").alias("blocking"))


@query("""WITH m AS (SELECT user_id, count(*) AS n, count(*) FILTER (value < 3) / count(*) AS er, count(*) FILTER (value >= 5) / count(*) AS rr, count(*) FILTER (value >= 50) AS a, count(*) FILTER (event_type = 'error') AS nj FROM events GROUP BY 1),
g AS (SELECT *, CASE WHEN er > 0.05 OR rr < 0.95 OR a <= 0 THEN 'FAIL' ELSE 'PASS' END AS resolution FROM m)
SELECT user_id, CASE WHEN er > 0.05 THEN 'FAIL' ELSE 'PASS' END AS artifact, resolution, CASE WHEN a = 0 OR resolution <> 'PASS' THEN 'FAIL' WHEN nj > 0 THEN 'WARN' ELSE 'PASS' END AS documents FROM g""")
def merge_gate_layers(spark, sf_dir):
    v = F.col("value")
    m = load(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("f2a_records"), F.count("*").alias("f2a_candidates"), (F.count_if(v < 3) / F.count("*")).alias("f2a_error_rate"), (F.count_if(v < 3) / F.count("*")).alias("resolver_error_rate"),
        (F.count_if(v >= 5) / F.count("*")).alias("resolved_document_ratio"), F.count_if(v >= 50).alias("merge_ready_candidates"), F.count_if(v >= 50).alias("accepted"), F.count_if(F.col("event_type") == "error").alias("not_joined"),
    )
    gate = G.merge_gate(F.struct(*m.columns))
    return m.select("user_id", gate.alias("g")).select("user_id", "g.artifact", "g.resolution", "g.documents")


@query("""WITH s AS (SELECT o_orderkey, year(o_orderdate) AS y FROM orders), c AS (SELECT count(*) AS source_records, count(*) FILTER (o_orderkey % 100 <> 0) AS sharded_records FROM s)
SELECT source_records, sharded_records, source_records - sharded_records AS ids_changed, 'record_count,ids_changed' AS issues, 'FAIL' AS verdict FROM c""")
def shard_check(spark, sf_dir):
    """Shards that lost every hundredth order do not pass."""
    source = load(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    years = (1996, 1997, 1998)
    shards = source.where("o_orderkey % 100 <> 0").withColumn("shard", F.when(F.col("y").isin(*years), F.col("y").cast("string")).otherwise("archive"))
    found = G.shard_validation(source, shards, "o_orderkey", "y", years, needed=(1997, 1998))
    return found.select("source_records", "sharded_records", "ids_changed", F.array_join("issues", ",").alias("issues"), "verdict")


@query("""WITH r AS (SELECT count(*) AS records, count(*) FILTER (c_acctbal > 0) AS active, count(*) FILTER (c_mktsegment = 'BUILDING') AS missing_category, count(*) FILTER (c_acctbal > 0 AND c_mktsegment = 'MACHINERY') AS active_with_award FROM customer)
SELECT *, 0::BIGINT AS missing_active, 0::BIGINT AS active_awarded, concat_ws(',', 'generation_id', CASE WHEN missing_category > 0 THEN 'missing_category' END, CASE WHEN active_with_award > 0 THEN 'active_with_award' END) AS issues, 'FAIL' AS verdict FROM r""")
def published_check(spark, sf_dir):
    """Customers read as published records: their segment is the lifecycle, a balance makes them active."""
    segment = F.col("c_mktsegment")
    category = F.when(segment == "BUILDING", None).when(segment == "MACHINERY", "OPEN_WITH_AWARD_EVIDENCE").otherwise("CLEAR_OPEN")
    records = load(spark, sf_dir, "customer").select(category.alias("lifecycle_category"), (F.col("c_acctbal") > 0).alias("active_opportunity_eligible"))
    meta = spark.range(1).select(F.lit("s/1").alias("schema"), F.lit("published").alias("publication_state"), F.lit("").alias("generation_id"), F.lit("d").alias("dataset_sha256"))
    return G.production_validation(records, meta, "s/1", "published").withColumn("issues", F.array_join("issues", ","))


@query("""SELECT p_partkey, s.source, CASE s.source WHEN 'a' THEN CASE WHEN p_size > 25 THEN 'failed' ELSE 'ok' END WHEN 'b' THEN 'ok' ELSE 'degraded' END AS status,
  CASE WHEN s.source = 'b' OR (s.source = 'a' AND p_size <= 25) THEN p_name END AS retrieved_at FROM part, (SELECT unnest(['a', 'b', 'c']) AS source) s""")
def source_status(spark, sf_dir):
    """The status of each source of all runs: parts, of which the large ones lost source a."""
    some = load(spark, sf_dir, "part")
    lists = {"requested": F.array(*map(F.lit, "abc")), "completed": F.array(*map(F.lit, "ab")), "failed": F.when(F.col("p_size") > 25, F.array(F.lit("a"))), "generated_at": F.col("p_name")}
    runs = some.select("p_partkey", *(c.alias(n) for n, c in lists.items()))
    own = lambda c: F.transform(c, lambda s: F.concat_ws("|", F.col("p_partkey").cast("string"), s))
    tagged = runs.withColumns({c: own(c) for c in ("requested", "completed", "failed")}).withColumn("generated_at", F.concat_ws("|", F.col("p_partkey").cast("string"), "generated_at"))
    found = G.source_coverage(tagged)
    part = lambda c, i: F.split_part(F.col(c), F.lit("|"), F.lit(i))
    return found.select(part("source", 1).cast("long").alias("p_partkey"), part("source", 2).alias("source"), "status", part("retrieved_at", 2).alias("retrieved_at"))


@query("""WITH d AS (SELECT user_id AS record, event_id AS position, CASE WHEN event_type IN ('view', 'click') THEN 'l' ELSE 't' END AS sec, 'http://x/' || (event_id % 700) AS url, value FROM events),
t AS (SELECT *, row_number() OVER (PARTITION BY record, sec ORDER BY position) AS turn FROM d), o AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY turn, sec) AS place FROM t),
k AS (SELECT * FROM o WHERE place <= 3), f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY url ORDER BY record, place) = 1), few AS (SELECT * FROM f ORDER BY record, place LIMIT 40),
g AS (SELECT record FROM few GROUP BY 1 ORDER BY min(record) LIMIT 12)
SELECT record, url, place FROM few WHERE record IN (SELECT record FROM g)""")
def document_targets(spark, sf_dir):
    """Events read as documents of users: at most three a record, forty addresses, twelve records."""
    rows = load(spark, sf_dir, "events").select(
        F.col("user_id").alias("record"), F.col("event_id").alias("position"), F.lit("feed_xml").alias("provenance"), F.when(F.col("event_type").isin("view", "click"), T.LEGAL).otherwise(T.TECHNICAL).alias("source_section"),
        F.concat(F.lit("http://x/"), (F.col("event_id") % 700).cast("string")).alias("url"),
    )
    found = T.select_targets(rows, [F.col("record")], "record", "position", 12, 40, 3)
    return found.select("record", "url", F.col("_place").alias("place"))

