"""Queries on single records: selection, names, addresses, lifecycle, best values, document lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import notices as N
from ..operators import fields as E
from ..operators import records as R
from ..sources.tables import load
from .orders import NOTICES, notices
from .registry import query


@query(NOTICES + """, s AS (SELECT count(*) AS records, count(*) FILTER (estat = 'Vigente') AS open, count(*) FILTER (estat = 'Adjudicado') AS awarded, count(*) FILTER (pressupost > 0) AS with_amount,
  round(sum(pressupost) FILTER (pressupost > 0), 2) AS amount, count(*) FILTER (organisme <> '') AS with_awardee FROM notices)
SELECT *, round(amount / with_amount, 2) AS mean_amount, floor(with_amount / records * 100 + 0.5)::BIGINT AS with_amount_pct FROM s""")
def run_summary(spark, sf_dir):
    return R.run_summary(notices(spark, sf_dir), F.col("estat"), F.col("pressupost"), F.col("organisme"))


@query("""SELECT event_id, CASE WHEN e = 'vigente' AND NOT a THEN 'CLEAR_OPEN' WHEN e = 'vigente' THEN 'OPEN_WITH_AWARD_EVIDENCE' WHEN e = 'adjudicada' OR a THEN 'CLEAR_AWARDED' ELSE 'UNKNOWN_LIFECYCLE' END AS category
FROM (SELECT event_id, value > 50 AS a, CASE event_type WHEN 'purchase' THEN 'adjudicada' WHEN 'view' THEN 'vigente' ELSE 'otro' END AS e FROM events)""")
def lifecycle_classify(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "adjudicada").when(kind == "view", "vigente").otherwise("otro")
    return load(spark, sf_dir, "events").select("event_id", N.lifecycle(status, F.col("value") > 50)["category"].alias("category"))


@query("""SELECT CASE WHEN regexp_matches(c, '^[A-Z]$') THEN c ELSE '#' END AS letter, count(*) AS n FROM (SELECT upper(strip_accents(left(trim(p_name), 1))) AS c FROM part) GROUP BY 1""")
def directory_letters(spark, sf_dir):
    return load(spark, sf_dir, "part").groupBy(R.first_letter(F.col("p_name")).alias("letter")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(strip_accents(c_name)), 'customer#0000001')")
def name_search(spark, sf_dir):
    """Names that hold a text, without regard to case and accents."""
    return load(spark, sf_dir, "customer").where(R.folded_contains(F.col("c_name"), "CÚSTOMER#0000001")).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'F')")
def unresolved_candidates(spark, sf_dir):
    """Candidates that the checkpoint does not hold: customers without a finished order."""
    done = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return R.unresolved(load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), done, "c_custkey")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 20 ORDER BY c_acctbal > 5000 DESC, c_custkey LIMIT 40")
def record_selection(spark, sf_dir):
    """The first forty records that meet the conditions, those with documents first."""
    rows = load(spark, sf_dir, "customer")
    found = R.selected(rows, F.col("c_acctbal") > 5000, "c_custkey", 40, F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey") < 20)
    return found.select("c_custkey", "c_acctbal")


@query("SELECT page_id, coalesce(regexp_matches(lower(trim(url)), '^https://[^/?#]'), false) AS valid FROM pages")
def valid_urls(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", R.valid_https(F.col("url")).alias("valid"))


_CONFIDENCE = "CASE WHEN value >= 70 THEN 'high' WHEN value >= 30 THEN 'medium' ELSE 'low' END"


@query(f"""SELECT user_id, event_type AS field, value, confidence, event_id FROM (SELECT *, {_CONFIDENCE} AS confidence FROM events)
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, event_id) = 1""")
def best_field_values(spark, sf_dir):
    """For each record and field the most confident value, the first one on a tie."""
    rows = load(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("field"), "value", F.expr(_CONFIDENCE).alias("confidence"), "event_id")
    return E.best_of_documents(rows, "user_id", "event_id")


@query("""SELECT user_id, coverage, CASE WHEN coverage >= 0.5 THEN 'ready' WHEN coverage >= 0.25 THEN 'partial' ELSE 'insufficient' END AS status
FROM (SELECT user_id, round(count(DISTINCT event_type) / 6, 3) AS coverage FROM events GROUP BY 1)""")
def field_coverage(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("field"))
    return E.coverage(rows, "user_id", 6)


@query("""SELECT user_id, event_type, first AS event_id, value FROM (SELECT *, min(event_id) OVER w AS first, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value > 90 DESC, event_id) AS place FROM events WINDOW w AS (PARTITION BY user_id, event_type)) WHERE place = 1""")
def document_union(spark, sf_dir):
    """One document of each identity at the place of its first, that of a resolver before others."""
    rows = load(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return R.distinct_documents(rows, "user_id", "event_type", "event_id", F.col("value") > 90)
