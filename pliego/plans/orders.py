"""Queries on orders read as notices: a nation is a territory, a customer an organisation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import notices as N
from ..functions.semantics import days_to, js_round, period_key
from ..operators import aggregates as A
from ..operators import dedup as D
from ..operators import gates as G
from ..operators import merge as M
from ..operators import partition as S
from ..operators import periods as P
from ..sources.tables import load
from .registry import query

AS_OF = datetime(1998, 1, 1)
STATUS = {"F": "Adjudicado", "O": "Vigente", "P": "Desierta"}
CODE = {"F": "ADJ", "O": "PUB", "P": "EV"}
TYPE = {"F": "AWARD", "O": "PUB", "P": "EV"}

#: The same reading for DuckDB.
NOTICES = """
WITH notices AS (
  SELECT o_orderkey AS id, c_custkey AS org_id, c_name AS organisme, n_name AS ccaa, n_regionkey AS region, o_totalprice AS pressupost,
         o_orderdate::DATE AS data_pub, o_orderpriority AS kind, o_orderstatus AS raw,
         CASE o_orderstatus WHEN 'F' THEN 'Adjudicado' WHEN 'O' THEN 'Vigente' WHEN 'P' THEN 'Desierta' END AS estat
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers, nations = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("o_orderkey").alias("id"), F.col("c_custkey").alias("org_id"), F.col("c_name").alias("organisme"), F.col("n_name").alias("ccaa"), F.col("n_regionkey").alias("region"),
        F.col("o_totalprice").alias("pressupost"), F.to_date("o_orderdate").alias("data_pub"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("raw"),
        N.mapped(STATUS, F.col("o_orderstatus")).alias("estat"),
    )


_MEDIAN = "list_sort(list(pressupost) FILTER (pressupost > 0))[(count(*) FILTER (pressupost > 0)) // 2 + 1]"
_PROFILE = f"""count(*) AS total, count(*) FILTER (estat = 'Vigente') AS open, count(*) FILTER (estat = 'Adjudicado') AS awarded, count(*) FILTER (estat = 'Desierta') AS void,
  count(*) FILTER (pressupost > 0) AS with_amount, {_MEDIAN} AS median_amount, min(pressupost) FILTER (pressupost > 0) AS min_amount,
  max(pressupost) FILTER (pressupost > 0) AS max_amount, round(sum(pressupost) FILTER (pressupost > 0), 2) AS sum_amount,
  count(*) - count(*) FILTER (estat IN ('Vigente', 'Adjudicado', 'Desierta')) AS other"""
_BUCKET = """CASE WHEN pressupost IS NULL OR NOT pressupost > 0 THEN 'Sin presupuesto' WHEN pressupost < 10000 THEN '< 10K' WHEN pressupost < 50000 THEN '10K–50K'
  WHEN pressupost < 100000 THEN '50K–100K' WHEN pressupost < 500000 THEN '100K–500K' ELSE '> 500K' END"""


@query(NOTICES + f"SELECT ccaa, {_PROFILE} FROM notices GROUP BY ccaa ORDER BY sum_amount DESC, ccaa LIMIT 10")
def nation_order_profile(spark, sf_dir):
    """The ten territories of highest volume with status split and distribution of amounts."""
    rows = A.profile(notices(spark, sf_dir), ["ccaa"], F.col("estat"), F.col("pressupost"))
    return rows.orderBy(F.desc("sum_amount"), "ccaa").limit(10)


@query(NOTICES + f"SELECT {_PROFILE} FROM notices")
def budget_profile(spark, sf_dir):
    return A.profile(notices(spark, sf_dir), [], F.col("estat"), F.col("pressupost"))


@query(NOTICES + f"SELECT ccaa, {_BUCKET} AS bucket, count(*) AS n FROM notices GROUP BY ALL")
def budget_buckets(spark, sf_dir):
    return A.bucket_counts(notices(spark, sf_dir), ["ccaa"], F.col("pressupost"))


@query(NOTICES + """, c AS (SELECT count(*) AS t, count(data_pub) AS d, count(*) FILTER (organisme <> '') AS o, count(*) FILTER (pressupost > 150000) AS l, count(*) FILTER (kind LIKE '1%') AS u FROM notices)
SELECT unnest(['data_pub', 'organisme', 'large', 'urgent']) AS field, unnest([d, o, l, u]) AS n, unnest([floor(100.0 * d / t + 0.5), floor(100.0 * o / t + 0.5), floor(100.0 * l / t + 0.5), floor(100.0 * u / t + 0.5)])::BIGINT AS pct FROM c""")
def coverage_ratios(spark, sf_dir):
    fields = {"data_pub": F.col("data_pub").isNotNull(), "organisme": F.col("organisme") != "", "large": F.col("pressupost") > 150000, "urgent": F.col("kind").startswith("1")}
    return A.coverage(notices(spark, sf_dir), fields)


_THIRD = "((month(data_pub) - 1) // 4 + 1)"
_METRICS = NOTICES + f""", m AS (SELECT year(data_pub)::INT AS year, {_THIRD}::INT AS third, count(*) AS total, count(*) FILTER (pressupost > 0) AS with_amount,
  {_MEDIAN} AS median_amount, round(sum(pressupost) FILTER (pressupost > 0), 2) AS sum_amount, count(*) FILTER (estat = 'Vigente') AS open,
  count(*) FILTER (estat = 'Adjudicado') AS awarded, count(*) FILTER (estat = 'Desierta') AS void, (year(data_pub) * 3 + {_THIRD} - 1)::INT AS idx FROM notices GROUP BY year, third, idx)"""


def _metrics(spark, sf_dir):
    return P.period_metrics(notices(spark, sf_dir), F.col("data_pub"), F.col("pressupost"), F.col("estat"))


@query(_METRICS + "SELECT * FROM m")
def period_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)


@query(_METRICS + """SELECT a.*, coalesce(b.total, 0) AS previous_total, a.total - coalesce(b.total, 0) AS delta,
  CASE WHEN b.total > 0 THEN floor((a.total - b.total) / b.total * 100 + 0.5)::BIGINT ELSE 0 END AS delta_pct FROM m a LEFT JOIN m b ON b.idx = a.idx - 1""")
def period_delta(spark, sf_dir):
    return P.with_previous(_metrics(spark, sf_dir))


@query(_METRICS + "SELECT i::INT AS idx, coalesce(m.total, 0) AS total FROM (SELECT unnest(generate_series(max(idx) - 5, max(idx))) AS i FROM m) LEFT JOIN m ON m.idx = i")
def period_series6(spark, sf_dir):
    return P.trailing(_metrics(spark, sf_dir), 6)


@query(_METRICS + "SELECT year, third FROM m ORDER BY idx DESC LIMIT 1")
def latest_period(spark, sf_dir):
    return P.latest(_metrics(spark, sf_dir))


@query(_METRICS + """, p AS (SELECT a.*, b.total AS bt, b.with_amount AS bw, b.void AS bv, (b.total IS NOT NULL AND a.total >= 10) AS c FROM m a LEFT JOIN m b ON b.idx = a.idx - 1)
SELECT year, third, signal FROM (SELECT year, third, unnest([CASE WHEN c AND total > bt THEN 'more_activity' WHEN c AND total < bt THEN 'less_activity' END,
  CASE WHEN c AND with_amount > bw THEN 'more_amounts' WHEN c AND with_amount < bw THEN 'fewer_amounts' END,
  CASE WHEN c AND void >= 3 AND floor(100.0 * void / total + 0.5) > floor(100.0 * bv / bt + 0.5) THEN 'more_void' END,
  CASE WHEN total < 10 THEN 'low_volume' END, CASE WHEN bt IS NULL THEN 'no_previous' END]) AS signal FROM p) WHERE signal IS NOT NULL""")
def period_signals(spark, sf_dir):
    return P.signals(_metrics(spark, sf_dir))


@query(NOTICES + f"SELECT ccaa, year(data_pub) || '-C' || {_THIRD} AS period, count(*) AS n FROM notices GROUP BY ALL")
def territory_periods(spark, sf_dir):
    return notices(spark, sf_dir).groupBy("ccaa", period_key(F.col("data_pub")).alias("period")).agg(F.count("*").alias("n"))


@query(NOTICES + """, f AS (SELECT organisme AS key, ccaa AS i, count(*) AS n, count(*) FILTER (pressupost > 0) AS an, sum(pressupost) FILTER (pressupost > 0) AS s FROM notices GROUP BY ALL)
SELECT key, sum(n)::BIGINT AS n, sum(an)::BIGINT AS amount_n, round(sum(s), 2) AS amount_sum, string_agg(i || ':' || n, ',' ORDER BY i) AS by FROM f GROUP BY key""")
def awardee_counts(spark, sf_dir):
    rows = A.nested_counts(notices(spark, sf_dir), F.col("organisme"), F.col("ccaa"), F.col("pressupost"))
    return rows.withColumn("by", F.array_join(F.transform("by", lambda x: F.concat(x["inner"], F.lit(":"), x["n"].cast("string"))), ","))


@query(NOTICES + """SELECT ccaa AS "outer", organisme AS "inner", count(*) AS n, row_number() OVER (PARTITION BY ccaa ORDER BY count(*) DESC, organisme)::INT AS rank FROM notices GROUP BY ccaa, organisme QUALIFY rank <= 8""")
def awardee_by_territory(spark, sf_dir):
    return A.ranked_inside(notices(spark, sf_dir), F.col("ccaa"), F.col("organisme"), 8)


@query("""SELECT l, n, round(n / sum(n) OVER (), 6) AS share, round(coalesce(sum(n) OVER (ORDER BY n DESC, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (), 6) AS start
FROM (SELECT l_returnflag || l_linestatus AS l, count(*) AS n FROM lineitem GROUP BY 1)""")
def donut_composition(spark, sf_dir):
    return A.composition(load(spark, sf_dir, "lineitem"), F.concat("l_returnflag", "l_linestatus")).withColumnRenamed("label", "l")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50")
def topk_budget(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(50)


@query("SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, min(p_partkey), 1 LIMIT 10")
def topk_counter(spark, sf_dir):
    return A.most_common(load(spark, sf_dir, "part"), F.col("p_type"), F.col("p_partkey"), 10)


_DAYS = "(data_pub - DATE '1998-01-01')"
_DISPLAY = f"CASE raw WHEN 'O' THEN CASE WHEN {_DAYS} >= 0 THEN 'open' ELSE 'expired' END WHEN 'P' THEN 'ev' ELSE 'adjudicado' END"


def _shown(df: DataFrame) -> DataFrame:
    """Notices with their display status, taking the date as the deadline."""
    deadline = F.col("data_pub").cast("string")
    return df.withColumns({"days": days_to(deadline, AS_OF), "display": N.display_status(N.mapped(CODE, F.col("raw")), F.col("estat"), deadline, AS_OF)})


@query(NOTICES + f"""SELECT id, organisme, ccaa, pressupost, {_DISPLAY} AS display FROM notices
WHERE pressupost >= 1000 AND kind IN ('1-URGENT', '2-HIGH') AND lower(organisme) LIKE '%customer%' ORDER BY ({_DISPLAY}) = 'open' DESC, pressupost DESC, id LIMIT 25 OFFSET 25""")
def multi_filter_sort_page(spark, sf_dir):
    """The second page of a filtered table, open notices first, then by amount."""
    rows = _shown(notices(spark, sf_dir)).where((F.col("pressupost") >= 1000) & F.col("kind").isin("1-URGENT", "2-HIGH") & F.lower("organisme").contains("customer"))
    return rows.orderBy((F.col("display") == "open").desc(), F.desc("pressupost"), "id").offset(25).limit(25).select("id", "organisme", "ccaa", "pressupost", "display")


@query(NOTICES + f""", d AS (SELECT *, {_DAYS} AS days, {_DISPLAY} AS display FROM notices)
SELECT id, CASE WHEN display <> 'open' THEN 'unknown' WHEN (pressupost > 0 AND pressupost < 3000) OR (days >= 0 AND days < 10) THEN 'bad'
  WHEN pressupost >= 10000 AND days >= 15 THEN 'good' ELSE 'medium' END AS light FROM d""")
def traffic_light(spark, sf_dir):
    return _shown(notices(spark, sf_dir)).select("id", N.traffic_light(F.col("display"), F.col("pressupost"), F.col("days"), F.lit("")).alias("light"))


@query(NOTICES + f""", d AS (SELECT *, {_DAYS} AS days, {_DISPLAY} AS display FROM notices)
SELECT id, concat_ws(',', CASE WHEN days >= 20 THEN 'ample_time' WHEN days >= 10 THEN 'fair_time' END, CASE WHEN pressupost >= 50000 THEN 'large_budget' WHEN pressupost >= 10000 THEN 'usual_budget' END,
    CASE WHEN display = 'open' THEN 'open_without_awardee' END) AS tips,
  concat_ws(',', CASE WHEN pressupost > 0 AND pressupost < 3000 THEN 'budget_below_minimum' END, CASE WHEN days >= 0 AND days < 10 THEN 'tight_deadline' END, CASE WHEN days < 0 THEN 'deadline_passed' END,
    CASE WHEN ccaa = 'SPAIN' THEN 'statewide' END) AS warns,
  concat_ws(',', CASE WHEN raw = 'P' THEN 'in_evaluation' END) AS notes FROM d""")
def advisory(spark, sf_dir):
    rows = _shown(notices(spark, sf_dir))
    where = F.when(F.col("ccaa") == "SPAIN", "ES").otherwise(F.col("ccaa"))
    a = N.advice(F.col("display"), N.mapped(CODE, F.col("raw")), F.col("pressupost"), F.col("days"), F.lit(""), where, F.lit(1), F.array().cast("array<string>"))
    return rows.select("id", a.alias("a")).select("id", *(F.array_join(f"a.{k}", ",").alias(k) for k in ("tips", "warns", "notes")))


@query(NOTICES + f""", d AS (SELECT *, {_DAYS} AS days, {_DISPLAY} AS display FROM notices)
SELECT count(*) AS total, count(*) FILTER (display = 'open') AS open, round(sum(pressupost), 2) AS volume, count(*) FILTER (display = 'open' AND days BETWEEN 0 AND 7) AS due, count(*) FILTER (days > -3) AS fresh FROM d""")
def kpi_strip(spark, sf_dir):
    rows = _shown(notices(spark, sf_dir))
    return rows.agg(
        F.count("*").alias("total"), F.count_if(F.col("display") == "open").alias("open"), F.round(F.sum(F.coalesce("pressupost", F.lit(0.0))), 2).alias("volume"),
        F.count_if((F.col("display") == "open") & F.col("days").between(0, 7)).alias("due"), F.count_if(N.is_new(F.col("data_pub").cast("string"), AS_OF)).alias("fresh"),
    )


@query("""SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 8 WHEN 'P' THEN 4 ELSE 2 END DESC, o_totalprice DESC, o_orderkey) = 1""")
def run_dedup_rank(spark, sf_dir):
    """One order of each customer: of highest rank, then of highest price, then the first."""
    rows = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    rank = N.status_rank(N.mapped(TYPE, F.col("o_orderstatus")))
    return D.best_of(rows, ["o_custkey"], [rank, F.col("o_totalprice"), -F.col("o_orderkey")])


def _states(spark, sf_dir):
    """Orders as the retained state, and what their lines say as the incoming one."""
    orders, lines = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    none = F.array().cast("array<struct<data:string,estat:string,nota:string>>")
    previous = orders.select(
        F.col("o_orderkey").alias("ckey"), N.mapped(TYPE, F.col("o_orderstatus")).alias("notice_type"), N.mapped(STATUS, F.col("o_orderstatus")).alias("estat"), F.lit("").alias("adjudicatari"),
        day("o_orderdate").alias("data_pub"), F.lit("").alias("data_limit"), day("o_orderdate").alias("first_pub_date"), day("o_orderdate").alias("last_notice_date"),
        F.col("o_totalprice").alias("pressupost"), F.array(F.lit("orders")).alias("sources_seen"), none.alias("historial"),
    )
    per_order = lines.groupBy("l_orderkey").agg(F.max("l_linestatus").alias("s"), F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"), F.min("l_suppkey").alias("w"))
    incoming = per_order.select(
        F.col("l_orderkey").alias("ckey"), F.when(F.col("s") == "F", "FORMALIZATION").otherwise("PUB").alias("notice_type"), F.when(F.col("s") == "F", "Adjudicado").otherwise("Vigente").alias("estat"),
        F.concat(F.lit("S"), F.col("w").cast("string")).alias("adjudicatari"), day("lo").alias("data_pub"), day("hi").alias("data_limit"), day("lo").alias("first_pub_date"), day("hi").alias("last_notice_date"),
        F.lit(0.0).alias("pressupost"), F.array(F.lit("lines")).alias("sources_seen"), none.alias("historial"),
    )
    return previous, incoming


@query("""WITH p AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'AWARD' WHEN 'O' THEN 'PUB' ELSE 'EV' END AS t, CASE o_orderstatus WHEN 'F' THEN 8 WHEN 'O' THEN 2 ELSE 4 END AS r,
  CASE o_orderstatus WHEN 'F' THEN 'Adjudicado' WHEN 'O' THEN 'Vigente' ELSE 'Desierta' END AS e, strftime(o_orderdate, '%Y-%m-%d') AS d, o_totalprice AS b FROM orders),
n AS (SELECT l_orderkey AS k, CASE WHEN max(l_linestatus) = 'F' THEN 'FORMALIZATION' ELSE 'PUB' END AS t, CASE WHEN max(l_linestatus) = 'F' THEN 10 ELSE 2 END AS r,
  CASE WHEN max(l_linestatus) = 'F' THEN 'Adjudicado' ELSE 'Vigente' END AS e, 'S' || min(l_suppkey) AS a, strftime(min(l_shipdate), '%Y-%m-%d') AS lo, strftime(max(l_shipdate), '%Y-%m-%d') AS hi FROM lineitem GROUP BY 1),
j AS (SELECT p.*, n.k AS nk, n.t AS nt, n.r AS nr, n.e AS ne, n.a, n.lo, n.hi, coalesce(p.k, n.k) AS ckey, p.k IS NOT NULL AND n.k IS NOT NULL AS both_, n.k IS NOT NULL AND (p.k IS NULL OR n.r > p.r) AS wins FROM p FULL JOIN n ON p.k = n.k)
SELECT ckey, CASE WHEN wins THEN nt ELSE t END AS notice_type,
  CASE WHEN both_ THEN CASE WHEN greatest(r, nr) >= 8 THEN 'Adjudicado' ELSE 'Vigente' END ELSE coalesce(e, ne) END AS estat, coalesce(a, '') AS adjudicatari,
  CASE WHEN wins THEN lo ELSE d END AS data_pub, coalesce(hi, '') AS data_limit, coalesce(least(d, lo), '') AS first_pub_date, coalesce(greatest(d, hi), '') AS last_notice_date, coalesce(b, 0.0) AS pressupost,
  CASE WHEN both_ THEN 'lines,orders' WHEN k IS NULL THEN 'lines' ELSE 'orders' END AS sources_seen,
  CASE WHEN both_ AND wins THEN CASE WHEN ne <> e THEN '1998-01-01|' || ne || '|' || CASE WHEN ne = 'Adjudicado' THEN 'Adjudicado a ' || a ELSE 'Cambio: ' || e || ' → ' || ne END ELSE '' END
    WHEN k IS NOT NULL AND nk IS NULL THEN '' ELSE CASE WHEN wins THEN lo ELSE d END || '|' || CASE WHEN wins THEN ne ELSE e END || '|Publicación' END AS historial,
  CASE WHEN both_ THEN 'updated' WHEN k IS NULL THEN 'new' ELSE 'preserved' END AS outcome FROM j""")
def rank_merge(spark, sf_dir):
    merged = M.rank_merge(*_states(spark, sf_dir), today="1998-01-01")
    line = F.transform("historial", lambda h: F.concat_ws("|", h["data"], h["estat"], h["nota"]))
    return merged.withColumn("sources_seen", F.array_join("sources_seen", ",")).withColumn("historial", F.array_join(line, ";"))


@query("""WITH p AS (SELECT c_custkey AS key, c_mktsegment AS seg, c_acctbal AS bal, CASE WHEN c_acctbal > 5000 THEN 'CLEAR_AWARDED' WHEN c_acctbal > 0 THEN 'CLEAR_OPEN' END AS lc FROM customer),
c AS (SELECT user_id AS key, event_type AS seg, value AS bal, event_id, CASE event_type WHEN 'purchase' THEN 'adjudicada' WHEN 'view' THEN 'vigente' ELSE 'otro' END AS e, CASE WHEN value > 50 THEN 'W' ELSE '' END AS a FROM events),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY event_id) = 1),
m AS (SELECT p.key, coalesce(f.e, 'publicada') AS estat, coalesce(f.a, '') AS adjudicatari, coalesce(f.seg, p.seg) AS seg, coalesce(f.bal, p.bal) AS bal,
  CASE WHEN f.key IS NULL THEN lc WHEN f.e = 'adjudicada' THEN 'CLEAR_AWARDED' WHEN f.e = 'vigente' AND f.a <> '' THEN 'OPEN_WITH_AWARD_EVIDENCE' WHEN f.a <> '' THEN 'CLEAR_AWARDED'
    WHEN lc = 'CLEAR_AWARDED' THEN lc WHEN f.e = 'vigente' OR lc = 'CLEAR_OPEN' THEN 'CLEAR_OPEN' ELSE 'UNKNOWN_LIFECYCLE' END AS lifecycle_category,
  CASE WHEN f.key IS NULL THEN 'production_only' ELSE 'overlap' END AS outcome FROM p LEFT JOIN f ON p.key = f.key),
n AS (SELECT key, e AS estat, a AS adjudicatari, seg, bal, CASE WHEN e = 'vigente' AND a = '' THEN 'CLEAR_OPEN' WHEN e = 'vigente' THEN 'OPEN_WITH_AWARD_EVIDENCE' WHEN e = 'adjudicada' OR a <> '' THEN 'CLEAR_AWARDED' ELSE 'UNKNOWN_LIFECYCLE' END AS lifecycle_category,
  'candidate_only' AS outcome FROM c WHERE key NOT IN (SELECT key FROM p)),
u AS (SELECT * FROM m UNION ALL SELECT * FROM n)
SELECT *, coalesce(lifecycle_category = 'CLEAR_OPEN', false) AS active, CASE WHEN outcome = 'production_only' THEN false ELSE coalesce(lifecycle_category IN ('OPEN_WITH_AWARD_EVIDENCE', 'UNKNOWN_LIFECYCLE'), false) END AS review FROM u""")
def lifecycle_merge(spark, sf_dir):
    """Customers as production, events of users as candidates: overlap, production only, candidate only."""
    customers, events = load(spark, sf_dir, "customer"), load(spark, sf_dir, "events")
    production = customers.select(
        F.col("c_custkey").alias("key"), F.lit("publicada").alias("estat"), F.lit("").alias("adjudicatari"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"),
        F.when(F.col("c_acctbal") > 5000, "CLEAR_AWARDED").when(F.col("c_acctbal") > 0, "CLEAR_OPEN").alias("lifecycle_category"), F.lit(False).alias("lifecycle_review_required"),
    )
    candidates = events.select(
        F.col("user_id").alias("key"), F.when(F.col("event_type") == "purchase", "adjudicada").when(F.col("event_type") == "view", "vigente").otherwise("otro").alias("estat"),
        F.when(F.col("value") > 50, "W").otherwise("").alias("adjudicatari"), F.col("event_type").alias("seg"), F.col("value").alias("bal"), F.col("event_id"),
    )
    return M.lifecycle_merge(production, candidates, "key", "event_id", ["seg", "bal"])


@query("""SELECT l_orderkey, string_agg(DISTINCT l_shipmode_or_flag, ',' ORDER BY l_shipmode_or_flag) AS flags FROM (SELECT l_orderkey, unnest([l_returnflag, l_linestatus]) AS l_shipmode_or_flag FROM lineitem) GROUP BY 1""")
def sorted_set_union(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("a"), F.collect_set("l_linestatus").alias("b"))
    return rows.select("l_orderkey", F.array_join(M.united_sets(F.col("a"), F.col("b")), ",").alias("flags"))


@query("""WITH g AS (SELECT l_orderkey, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS base, list(l_partkey % 100 ORDER BY l_linenumber, l_partkey % 100) AS inc FROM lineitem GROUP BY 1),
x AS (SELECT l_orderkey, base, list_filter(inc, lambda v: NOT list_contains(base, v)) AS fresh FROM g)
SELECT l_orderkey, array_to_string(list_concat(base, list_filter(fresh, lambda v, i: list_position(fresh, v) = i)), ',') AS merged FROM x""")
def list_union(spark, sf_dir):
    """Ordered union that keeps the base as it is, repeats included."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", c.alias("v")))), lambda x: x["v"])
    rows = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(ordered(F.col("l_suppkey")).alias("base"), ordered(F.col("l_partkey") % 100).alias("inc"))
    return rows.select("l_orderkey", F.array_join(M.united(F.col("base"), F.col("inc")), ",").alias("merged"))


@query("SELECT coalesce(a.k, b.k) AS value, coalesce(a.n, 0)::BIGINT AS in_a, coalesce(b.n, 0)::BIGINT AS in_b FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT c_custkey AS k, count(*) AS n FROM customer GROUP BY 1) b ON a.k = b.k WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)")
def multiset_difference(spark, sf_dir):
    orders, customers = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    return A.multiset_difference(orders.select(F.col("o_custkey").alias("k")), customers.select(F.col("c_custkey").alias("k")), "k")


@query("""SELECT CASE WHEN year(o_orderdate) IN (1996, 1997, 1998) THEN year(o_orderdate)::VARCHAR ELSE 'archive' END AS shard, CASE WHEN year(o_orderdate) IN (1997, 1998) THEN 1 WHEN year(o_orderdate) = 1996 THEN 2 ELSE 3 END AS priority, count(*) AS records FROM orders GROUP BY ALL""")
def shard_partition(spark, sf_dir):
    years = (1996, 1997, 1998)
    rows = load(spark, sf_dir, "orders").withColumn("shard", S.shard_of(S.year_of(F.date_format("o_orderdate", "yyyy-MM-dd")), years))
    return S.manifest(rows, "shard", years, "o_orderkey").drop("digest")


@query(NOTICES + """SELECT ccaa, id, pressupost, round((5 + 0.0) * least(12, greatest(5, log10(pressupost + 1) * 2.5)) / 5, 4) AS radius, row_number() OVER (PARTITION BY ccaa ORDER BY pressupost DESC, id) - 1 AS place
FROM notices QUALIFY place < 50""")
def map_markers(spark, sf_dir):
    """The fifty largest notices of each territory, with marker size and place in the circle."""
    radius = F.greatest(F.lit(5.0), F.least(F.lit(12.0), F.log10(F.col("pressupost") + 1) * 2.5))
    rows = D.top_n(notices(spark, sf_dir).select("ccaa", "id", "pressupost"), ["ccaa"], [F.desc("pressupost"), F.col("id")], 50)
    place = F.row_number().over(Window.partitionBy("ccaa").orderBy(F.desc("pressupost"), "id")) - 1
    return rows.select("ccaa", "id", "pressupost", F.round(radius, 4).alias("radius"), place.cast("long").alias("place"))


@query("""SELECT l_orderkey, sum(floor(l_quantity * l_extendedprice / l_quantity * (1 + l_tax) * (1 - l_discount) + 0.5))::BIGINT AS fee FROM lineitem GROUP BY 1""")
def fee_calculator(spark, sf_dir):
    """Rounded fees of hours, rate and two multipliers, summed by order."""
    fee = js_round(F.col("l_quantity") * F.col("l_extendedprice") / F.col("l_quantity") * (1 + F.col("l_tax")) * (1 - F.col("l_discount")))
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(fee).cast("long").alias("fee"))


@query(NOTICES + """, m AS (SELECT count(*) AS total, count(data_pub) AS with_date, count(*) FILTER (organisme <> '') AS with_org, count(DISTINCT kind) AS kinds, count(*) FILTER (pressupost > 0) AS with_amount,
  count(*) FILTER (kind LIKE '5%') AS no_kind, count(*) FILTER (raw = 'F') AS with_docs, count(*) FILTER (ccaa <> '') AS with_place FROM notices)
SELECT s AS signal FROM (SELECT unnest([CASE WHEN floor(100.0 * with_date / total + .5) >= 90 THEN 'dates_covered' END, CASE WHEN floor(100.0 * with_org / total + .5) >= 90 THEN 'organisations_covered' END, CASE WHEN kinds >= 6 THEN 'many_kinds' END,
  CASE WHEN floor(100.0 * with_amount / total + .5) >= 50 THEN 'amounts_common' END, CASE WHEN floor(100.0 * no_kind / total + .5) >= 25 THEN 'many_unclassified' END, CASE WHEN floor(100.0 * with_docs / total + .5) < 50 THEN 'few_documents' END,
  CASE WHEN floor(100.0 * (total - with_place) / total + .5) >= 20 THEN 'places_missing' END, CASE WHEN floor(100.0 * (total - with_amount) / total + .5) >= 50 THEN 'amounts_missing' END]) AS s FROM m) WHERE s IS NOT NULL""")
def structural_signals(spark, sf_dir):
    m = notices(spark, sf_dir).agg(
        F.count("*").alias("total"), F.count("data_pub").alias("with_date"), F.count_if(F.col("organisme") != "").alias("with_org"), F.count_distinct("kind").alias("kinds"),
        F.count_if(F.col("pressupost") > 0).alias("with_amount"), F.count_if(F.col("kind").startswith("5")).alias("no_kind"), F.count_if(F.col("raw") == "F").alias("with_docs"), F.count_if(F.col("ccaa") != "").alias("with_place"),
    )
    return m.select(F.explode(G.structural_signals(F.struct(*m.columns))).alias("signal"))


@query("""SELECT l_returnflag, l_linestatus, median FROM (SELECT l_returnflag, l_linestatus, list(l_extendedprice ORDER BY l_extendedprice) AS v, v[len(v) // 2 + 1] AS median FROM lineitem GROUP BY 1, 2)""")
def exact_medians(spark, sf_dir):
    """The upper median of prices of a few very large groups, without holding a group's values."""
    return A.medians(load(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_extendedprice"))
