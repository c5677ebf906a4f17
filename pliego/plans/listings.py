"""Queries on exports and editions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.semantics import number_es
from ..operators import aggregates as A
from ..operators import dedup as D2
from ..operators import editions as D
from ..operators import evidence as E
from ..operators import selection as Sel
from ..operators import signals as Sig
from ..operators import views as V
from ..sources.exports import export_lines
from ..sources.tables import load
from .registry import query


@query("""SELECT c_custkey, '"' || c_custkey || '";"' || replace(c_name, '"', '""') || '";"' || coalesce(c_mktsegment, '') || ',' || c_nationkey || '"' AS line FROM customer""")
def export_rows(spark, sf_dir):
    """Lines of the table export, a list among the columns."""
    rows = load(spark, sf_dir, "customer").withColumn("tags", F.array(F.coalesce("c_mktsegment", F.lit("")), F.col("c_nationkey").cast("string")))
    return export_lines(rows, ("c_custkey", "c_name", "tags")).select("c_custkey", "line")


@query("""SELECT r_regionkey AS year, CASE WHEN r_regionkey = 0 THEN 'Edition 0' ELSE r_name END AS title, r_regionkey <> 1 AS has_stats, coalesce(categories, 0) AS categories, coalesce(jurors, 0) AS jurors
FROM region LEFT JOIN (SELECT n_regionkey, count(*) AS categories FROM nation GROUP BY 1) n ON n_regionkey = r_regionkey LEFT JOIN (SELECT c_nationkey, count(*) AS jurors FROM customer GROUP BY 1) c ON c_nationkey = r_regionkey""")
def edition_summary(spark, sf_dir):
    """Editions with their numbers of categories and jurors; regions stand for editions."""
    year = F.col("r_regionkey")
    editions = load(spark, sf_dir, "region").select(
        year.alias("year"), year.alias("pos"), F.when(year == 0, "").otherwise(F.col("r_name")).alias("edition_label"), F.lit("").alias("status_note"),
        F.when(year != 1, 10).alias("participants"), *(F.lit(None).cast("int").alias(c) for c in D.STATS[1:]),
    )
    categories = load(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("year"))
    juries = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("year"))
    return D.edition_summary(editions, categories, juries, "Edition").select("year", "title", "has_stats", "categories", "jurors")


@query("""SELECT c_nationkey AS year, c_custkey AS pos, category, min(c_custkey) OVER (PARTITION BY c_nationkey, category) AS group_pos, chair
FROM (SELECT *, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Sin categoría asignada' ELSE c_mktsegment END AS category, c_acctbal > 9000 AS chair FROM customer
  WHERE contains(lower(c_name), '7') OR contains(lower(c_mktsegment), '7'))""")
def jury_groups(spark, sf_dir):
    """Jurors that a text finds, by year and category; customers stand for jurors."""
    segment = F.col("c_mktsegment")
    rows = load(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("year"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("name"), segment.alias("role"), F.lit(None).cast("string").alias("studio_or_context"),
        F.when(segment != "BUILDING", segment).alias("category_judged"), (F.col("c_acctbal") > 9000).alias("is_chair"),
    )
    return D.jury_groups(D.jurors_found(rows, " 7 ")).select("year", "pos", "category", "group_pos", "chair")


_PILOT = """r AS (SELECT c_custkey AS id, 'b' || (c_custkey % 17) AS organisme, n_name AS ccaa, c_acctbal > 2000 AS valid, count(o_orderkey) AS n, list(o_orderkey::VARCHAR ORDER BY o_orderkey) AS docs FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
t AS (SELECT *, CASE WHEN valid THEN 1 ELSE 2 END AS tier FROM r), u AS (SELECT *, row_number() OVER g AS turn, first_value({'n': n, 'o': organisme, 'c': ccaa, 'i': id::VARCHAR}) OVER g AS first FROM t WINDOW g AS (PARTITION BY tier, organisme, ccaa ORDER BY n, id::VARCHAR)),
o AS (SELECT *, row_number() OVER (ORDER BY tier, turn, first, n, organisme, ccaa, id::VARCHAR) - 1 AS place, least(n, 4) AS size FROM u),
s AS (SELECT *, coalesce(sum(size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)"""


@query(f"WITH {_PILOT} SELECT place::INT AS place, id, CASE tier WHEN 1 THEN 'deadline_valid' ELSE 'strict_temporal_fallback' END AS selection_tier, array_to_string(docs[:least(size, 1001 - before)], ',') AS documents FROM s WHERE place < 600 AND before < 1001")
def pilot_selection(spark, sf_dir):
    """Records for a pilot, bodies and territories in turn, at most 600 with 1001 documents; customers with their orders stand for records."""
    orders = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k.cast("string")).alias("documents"))
    rows = load(spark, sf_dir, "customer").join(F.broadcast(load(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey")).select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("b"), (F.col("c_custkey") % 17).cast("string")).alias("organisme"), F.col("n_name").alias("ccaa"), (F.col("c_acctbal") > 2000).alias("valid")
    )
    found = Sel.pilot(rows.join(orders, "id"), "documents", F.col("valid"), 600, 1001, 4)
    return found.select("place", "id", "selection_tier", F.array_join("documents", ",").alias("documents"))


_SELECTION = """m AS (SELECT c_nationkey, count(*) AS n, count(*) FILTER (c_custkey % 13 <> 0) AS wd, count(*) FILTER (c_custkey % 4 <> 0) AS wo, count(DISTINCT c_mktsegment) + c_nationkey % 3 AS disc, count(*) FILTER (c_acctbal > 5000) AS wb, count(*) FILTER (c_mktsegment = 'BUILDING') AS un,
    count(*) FILTER (c_custkey % 2 = 0) AS wx, count(*) FILTER (c_nationkey % 5 <> 0 OR c_custkey % 3 = 0) AS wt, count(*) FILTER (c_nationkey = 7) AS es, count(*) FILTER (c_acctbal > 9000 AND c_nationkey < 20) AS wa FROM customer GROUP BY 1),
p AS (SELECT *, floor(wd / n * 100 + 0.5) AS pd, floor(wo / n * 100 + 0.5) AS po, floor(wb / n * 100 + 0.5) AS pb, floor(un / n * 100 + 0.5) AS pu, floor(wx / n * 100 + 0.5) AS px, floor((n - wt) / n * 100 + 0.5) AS pt, floor((n - wb) / n * 100 + 0.5) AS pn FROM m)"""
_PCT = lambda c, n="n": f"CASE WHEN {c} = 0 THEN '0%' WHEN floor({c} / {n} * 100 + 0.5) = 0 THEN '<1%' ELSE floor({c} / {n} * 100 + 0.5)::INT || '%' END"
_NUM = lambda c: f"CASE WHEN {c} < 10000 THEN ({c})::VARCHAR ELSE replace(format('{{:,}}', ({c})::BIGINT), ',', '.') END"


def _signal(condition: str, label: str, reason: str) -> str:
    return f"CASE WHEN {condition} THEN '{label}: ' || {reason} END"


def _joined(*signals: str) -> str:
    return f"array_to_string(list_filter([{', '.join(signals)}], lambda x: x IS NOT NULL), ' | ')"


def _spoken(column):
    return F.array_join(F.transform(column, lambda x: F.concat_ws(": ", x["label"], x["reason"])), " | ")


_OF = lambda c, end: f"{_NUM(c)} || ' de ' || {_NUM('n')} || ' registros (' || {_PCT(c)} || '){end}'"


@query(f"""WITH {_SELECTION} SELECT c_nationkey,
  {_joined(_signal("pd >= 90", "Alta cobertura de fecha de publicación", _OF("wd", " informan fecha.")), _signal("po >= 90", "Alta cobertura de organismo", _OF("wo", " informan organismo.")), _signal("disc >= 6", "Amplitud de disciplinas", "disc || ' disciplinas presentes en la selección.'"), _signal("pb >= 50", "Presupuesto base informado con frecuencia", _OF("wb", " con presupuesto base.")))} AS positive,
  {_joined(_signal("pu >= 25", "Alta proporción sin disciplina", f"{_NUM('un')} || ' registros (' || {_PCT('un')} || ') aún sin clasificar · calidad de datos.'"), _signal("px < 50", "Cobertura documental baja", "'Solo ' || " + _OF("wx", " tienen documentos enlazados.")),
           _signal("pt >= 20", "Registros sin territorio", f"{_NUM('(n - wt)')} || ' registros (' || {_PCT('(n - wt)')} || ') no informan territorio.'"), _signal("pn >= 50", "Mayoría sin presupuesto informado", _OF("(n - wb)", " sin presupuesto base.")))} AS negative,
  {_joined(_signal("es > 0", "Concentración estatal (ES)", f"'El ámbito estatal supone el ' || {_PCT('es')} || ' de la selección y no equivale a un territorio local.'"), _signal("true", "Cobertura 2024–actual", "'El dataset no es un censo completo del mercado.'"),
           _signal("wb > 0", "Presupuesto base orientativo", "'No es el importe de adjudicación ni equivale al valor de mercado.'"), _signal("wx > 0", "Documentos enlazados", "'Enlazados desde el expediente, no leídos ni analizados.'"),
           _signal("wa > 0", "Adjudicataria informada", "'Campo informado en el expediente; no acredita la adjudicación real ni sus importes.'"))} AS caution FROM p""")
def selection_signals(spark, sf_dir):
    """What the coverage of a selection says for it, against it and with caution; nations stand for selections."""
    key, balance, nation = F.col("c_custkey"), F.col("c_acctbal"), F.col("c_nationkey")
    m = load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        F.count("*").alias("total"), F.count_if(key % 13 != 0).alias("with_date"), F.count_if(key % 4 != 0).alias("with_org"), F.count_distinct("c_mktsegment").alias("disciplines"), F.count_if(balance > 5000).alias("with_budget"),
        F.count_if(F.col("c_mktsegment") == "BUILDING").alias("unclassified"), F.count_if(key % 2 == 0).alias("with_documents"), F.count_if((nation % 5 != 0) | (key % 3 == 0)).alias("with_territory"), F.count_if(nation == 7).alias("national"), F.count_if((balance > 9000) & (nation < 20)).alias("with_awardee"),
    ).withColumn("disciplines", F.col("disciplines") + nation % 3)
    found = m.select("c_nationkey", Sig.structural(F.struct(*m.columns)).alias("s"))
    return found.select("c_nationkey", *(_spoken(F.col(f"s.{c}")).alias(c) for c in ("positive", "negative", "caution")))


_PERIODS = """m AS (SELECT c_nationkey, year(o_orderdate) AS y, count(*) AS n, count(*) FILTER (o_totalprice > 150000) AS b, count(*) FILTER (o_orderkey % 3 = 0) AS d, count(DISTINCT o_orderpriority) AS k, count(*) FILTER (o_orderpriority = '5-LOW') AS u, count(*) FILTER (o_orderstatus = 'P') AS v,
    count(*) FILTER (c_nationkey = 3) AS e FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
q AS (SELECT a.*, p.n AS pn, p.b AS pb, p.d AS pd, p.k AS pk, p.u AS pu, p.v AS pv, p.n IS NOT NULL AS has, a.y = 1998 AS running FROM m a LEFT JOIN m p ON p.c_nationkey = a.c_nationkey AND p.y = a.y - 1),
r AS (SELECT *, has AND NOT (n > 0 AND n < 10) AND y < 1999 AS cmp, floor(d / n * 100 + 0.5)::INT AS dd, floor(pd / pn * 100 + 0.5)::INT AS pdd, floor(u / n * 100 + 0.5)::INT AS uu, floor(pu / pn * 100 + 0.5)::INT AS puu, floor(v / n * 100 + 0.5)::INT AS vv, floor(pv / pn * 100 + 0.5)::INT AS pvv FROM q)"""
_VS = lambda a, b, unit="": f"{a} || '{unit} vs ' || {b} || '{unit}'"


@query(f"""WITH {_PERIODS} SELECT c_nationkey, y::INT AS year,
  {_joined(_signal("cmp AND n > pn", "Más actividad que el periodo anterior", "'+' || (n - pn) || ' vs ' || (y - 1) || ' (' || pn || ')'"), _signal("cmp AND b > pb", "Más registros con presupuesto", _VS("b", "pb")), _signal("cmp AND dd > pdd", "Mayor cobertura documental", _VS("dd", "pdd", "%")), _signal("cmp AND k > pk", "Más disciplinas presentes", _VS("k", "pk")))} AS positive,
  {_joined(_signal("cmp AND n < pn", "Menos actividad que el periodo anterior", "(n - pn) || ' vs ' || (y - 1) || ' (' || pn || ')'"), _signal("cmp AND b < pb", "Menos registros con presupuesto", _VS("b", "pb")), _signal("cmp AND dd < pdd", "Menor cobertura documental", _VS("dd", "pdd", "%")), _signal("cmp AND k < pk", "Menos disciplinas presentes", _VS("k", "pk")),
           _signal("cmp AND u > 0 AND uu > puu", "Más registros sin disciplina", _VS("uu", "puu", "%") + " || ' · calidad de datos'"), _signal("cmp AND v >= 3 AND vv > pvv", "Mayor proporción de desiertas", _VS("vv", "pvv", "%")))} AS negative,
  {_joined(_signal("n < 10", "Periodo de bajo volumen", "'Solo ' || n || ' registros: evita conclusiones fuertes.'"), _signal("running", "Periodo en curso", "'Cifras parciales; la comparación con periodos cerrados es orientativa.'"), _signal("NOT has AND y < 1999", "Sin periodo anterior comparable", "'No hay cuatrimestre previo en la cobertura para comparar.'"),
           _signal("e > 0", "Concentración estatal (ES)", "'El ámbito estatal supone el ' || floor(e / n * 100 + 0.5)::INT || '% y puede distorsionar la lectura territorial.'"), _signal("true", "Cobertura 2024–actual", "'El dataset no es un censo completo del mercado.'"),
           _signal("b > 0", "Presupuesto orientativo", "'El presupuesto base no equivale al valor de mercado.'"), _signal("true", "Documentos enlazados", "'Los documentos están enlazados, no leídos ni analizados.'"))} AS caution FROM r""")
def period_messages(spark, sf_dir):
    """What a period says against the one before; the years of a nation's orders stand for periods."""
    orders = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    m = orders.groupBy("c_nationkey", F.year("o_orderdate").alias("year")).agg(
        F.count("*").alias("total"), F.count_if(F.col("o_totalprice") > 150000).alias("with_budget"), F.count_if(F.col("o_orderkey") % 3 == 0).alias("with_documents"), F.count_distinct("o_orderpriority").alias("disciplines"),
        F.count_if(F.col("o_orderpriority") == "5-LOW").alias("unclassified"), F.count_if(F.col("o_orderstatus") == "P").alias("void"), F.count_if(F.col("c_nationkey") == 3).alias("national"),
    )
    measures = F.struct(*(c for c in m.columns if c not in ("c_nationkey", "year")))
    before = m.select("c_nationkey", (F.col("year") + 1).alias("year"), measures.alias("before"))
    rows = m.select("c_nationkey", "year", measures.alias("now")).join(before, ["c_nationkey", "year"], "left")
    found = Sig.periodic(F.col("now"), F.col("before"), F.col("before").isNotNull(), F.col("year") > 1998, F.col("year") == 1998, (F.col("year") - 1).cast("string"))
    return rows.select("c_nationkey", "year", found.alias("s")).select("c_nationkey", "year", *(_spoken(F.col(f"s.{c}")).alias(c) for c in ("positive", "negative", "caution")))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity < 5 THEN 'below_min_confidence' WHEN l_partkey % 7 = 0 THEN 'ver_title' WHEN l_partkey % 7 = 1 THEN 'generic_nav' WHEN l_partkey % 7 = 2 THEN 'generic_html_xml'
  WHEN l_partkey % 7 = 3 AND max(CASE WHEN l_quantity >= 5 AND l_partkey % 7 > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) = 1 THEN 'pdf_preferred' END AS skipped FROM lineitem""")
def skipped_links(spark, sf_dir):
    """Why links are not followed; the lines of an order stand for the variants of a document."""
    k = F.col("l_partkey") % 7
    rows = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(k == 0, " VER ").when(k == 1, "Búsqueda de  poderes adjudicadores").when(k == 2, "Documento HTML").when(k == 3, "Pliego html").otherwise("Pliego PDF").alias("text"),
        F.when(F.col("l_quantity") < 5, "low").otherwise("high").alias("confidence"), F.when(k == 3, "").otherwise("pdf").alias("extension"), F.lit("f").alias("family"),
    )
    return E.with_skips(rows, "l_orderkey", 1).select("l_orderkey", "l_linenumber", "l_partkey", "skipped")


@query("""SELECT count(DISTINCT k) FILTER (k <> 'no') AS identities, count(*) FILTER (k = 'no') AS unsupported FROM (SELECT CASE c_custkey % 6 WHEN 0 THEN 'n' || (c_custkey % 500) WHEN 1 THEN 's' || (c_custkey % 400) WHEN 2 THEN 's' || c_mktsegment WHEN 3 THEN 'i' || c_custkey WHEN 4 THEN 'b' ELSE 'no' END AS k FROM customer WHERE NOT (c_custkey % 6 = 0 AND c_custkey % 500 = 0))""")
def script_identities(spark, sf_dir):
    """How many keys a script's map has over JSON records of customers."""
    k, key = F.col("c_custkey") % 6, F.col("c_custkey")
    text = (
        F.when(k == 0, F.concat(F.lit('{"id":'), (key % 500).cast("string"), F.when(key % 12 == 0, ".0}").otherwise("}"))).when(k == 1, F.concat(F.lit('{"id":"'), (key % 400).cast("string"), F.lit('"}')))
        .when(k == 2, F.concat(F.lit('{"id":0,"url":"'), F.col("c_mktsegment"), F.lit('"}'))).when(k == 3, '{"id":false,"url":""}').when(k == 4, '{"id":true}').otherwise('{"id":[1]}')
    )
    return A.script_identities(load(spark, sf_dir, "customer").where(~((k == 0) & (key % 500 == 0))).select("c_custkey", text.alias("t")), "t", "c_custkey")


@query("""SELECT count(*) AS n, round(sum(o_totalprice), 2) AS amount, CASE WHEN count(*) < 10000 THEN count(*)::VARCHAR ELSE replace(format('{:,}', count(*)), ',', '.') END AS shown FROM orders WHERE year(o_orderdate) = 1996 AND month(o_orderdate) > 8 AND o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '5-LOW')""")
def statistics_filter(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("data_pub"), F.lit("CT").alias("ccaa"), F.col("o_orderstatus").alias("estat"), F.array("o_orderpriority").alias("disciplines"), "o_totalprice",
    )
    found = V.statistics_rows(rows, "1996", "CT", "O", ["1-URGENT", "5-LOW"], 3)
    return found.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("amount"), number_es(F.count("*")).alias("shown"))


@query("""WITH f AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events), o AS (SELECT *, CASE WHEN k = 1 THEN CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 END END AS first FROM f)
SELECT event_id, event_type FROM o ORDER BY first NULLS LAST, event_id LIMIT 5""")
def spread_sample(spark, sf_dir):
    """Five events: the first purchase and the first view, then others as they come."""
    return D2.spread(load(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", ["purchase", "view"], "event_id")
