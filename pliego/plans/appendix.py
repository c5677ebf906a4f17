"""Queries on the fields of documents and notices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import appendix as A
from ..operators import notice_fields as N
from ..sources.tables import load
from .registry import query

# Headings that the test corpus has, by field and role.
VARIANTS = {
    "objeto": ("licensed under", "released under"), "lotes": ("der", "nicht", "die"), "alcance_tecnico": ("the and", "of was", "in oredble"), "presupuesto_base": ("version 2", "apache license", "mit license"),
    "penalidades": ("treque", "leouer", "en la"), "entregables": ("tion", "theand thble", "with the"),
}
ROLES = {"pcap": ("objeto", "lotes", "presupuesto_base", "penalidades"), "ppt": ("objeto", "alcance_tecnico", "entregables")}
CORE = ("objeto", "lotes", "alcance_tecnico", "presupuesto_base", "penalidades")

_TABLE = ", ".join(f"('{f}', '{v}')" for f, vs in VARIANTS.items() for v in vs)
_BREAKS = "\\r\\n|[\\n\\x0b\\x0c\\r\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"
_TRIM = "regexp_replace({0}, '^[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}]+|[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}]+$', '', 'g')"
_WINDOWS = f"""v(field, variant) AS (VALUES {_TABLE}),
x AS (SELECT doc_id, unnest(string_split_regex(text, '{_BREAKS}')) AS raw, generate_subscripts(string_split_regex(text, '{_BREAKS}'), 1) AS line_no FROM documents),
l AS (SELECT *, {_TRIM.format("raw")} AS s, regexp_replace(raw, '[^\\p{{L}}]', '', 'g') AS letters, lower(strip_accents(trim(regexp_replace(raw, '\\s+', ' ', 'g')))) AS norm FROM x),
h AS (SELECT *, length(s) BETWEEN 1 AND 130 AND (regexp_matches(raw, '^\\s*[0-9]{{1,2}}(\\.[0-9]{{1,2}})*\\s*[.\\-)]?\\s+\\S') OR regexp_matches(s, '^[A-Z]\\.?\\s*[0-9]{{0,2}}\\.?\\s+[A-ZÁÉÍÓÚÑ]') OR regexp_matches(s, '^[A-Z][).]\\s+\\S')
    OR length(letters) >= 4 AND length(regexp_replace(letters, '\\p{{Ll}}', '', 'g')) >= 0.7 * length(letters)) AS head, regexp_matches(raw, '\\.{{4,}}') OR regexp_matches(s, '\\.{{2,}}\\s*[0-9]{{1,4}}$') AS leader FROM l),
c AS (SELECT *, leader OR coalesce(lead(leader) OVER (PARTITION BY doc_id, s = '' ORDER BY line_no), false) AS contents, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM h),
t AS (SELECT DISTINCT field, c.* FROM c JOIN v ON contains(norm, variant) AND regexp_matches(norm[:strpos(norm, variant) - 1], '(^|[^\\p{{L}}\\p{{N}}])$') AND NOT regexp_matches(norm[strpos(norm, variant) + length(variant):], '^[\\p{{L}}\\p{{N}}]')),
b AS (SELECT t.doc_id, t.field, t.line_no, any_value(t.head) AS head, any_value(t.contents) AS contents, any_value(t.s) AS s, coalesce(string_agg(c.raw, chr(10) ORDER BY c.line_no), '') AS body
      FROM t LEFT JOIN c ON c.doc_id = t.doc_id AND c.section = t.section AND c.line_no > t.line_no GROUP BY t.doc_id, t.field, t.line_no),
w AS (SELECT *, CASE WHEN {_TRIM.format("body[:4000]")} = '' THEN s ELSE s || chr(10) || {_TRIM.format("body[:4000]")} END AS win, length(body) + 1 > 4000 AS cut FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY contents, CASE WHEN contents THEN 0 ELSE length(replace(win, '.', '')) + CASE WHEN head THEN 400 ELSE 0 END END DESC, line_no) AS k, length(regexp_replace(win, '[^\\p{{L}}]', '', 'g')) AS n_letters FROM w),
p AS (SELECT *, contents OR n_letters < 25 OR length(win) - length(replace(win, '.', '')) >= 20 AND n_letters < 0.45 * length(win) AS only_pointer, regexp_replace(s, '\\.{{2,}}.*$', '') AS label FROM o WHERE k = 1),
f AS (SELECT doc_id, field, (CASE WHEN only_pointer THEN label ELSE win END)[:2500] AS value, (CASE WHEN only_pointer THEN label ELSE s END)[:120] AS heading, CASE WHEN only_pointer OR head THEN 'heading_window' ELSE 'keyword_window' END AS method,
        CASE WHEN only_pointer THEN 'low' WHEN head AND length(win) > 200 THEN 'high' WHEN length(win) > 120 THEN 'medium' ELSE 'low' END AS confidence, only_pointer, NOT only_pointer AND (cut OR length(win) > 2500) AS truncated FROM p)"""


@query(f"WITH {_WINDOWS} SELECT * FROM f")
def field_windows(spark, sf_dir):
    """The best window of each field that a document names; words of the corpus stand for headings."""
    return A.field_windows(load(spark, sf_dir, "documents"), "doc_id", "text", VARIANTS).drop("excerpt", "page")


_LISTS = {r: ", ".join(f"'{f}'" for f in fs) for r, fs in ROLES.items()}
_RECORDS = f"""{_WINDOWS},
d AS (SELECT doc_id, source, CASE doc_id % 3 WHEN 0 THEN 'pcap' WHEN 1 THEN 'ppt' ELSE 'acta' END AS role, CASE WHEN doc_id % 3 = 2 THEN NULL WHEN text IS NULL THEN 'missing' WHEN n_chars = 0 THEN 'empty'
        WHEN len(string_split(text, chr(10))) >= 10 AND (round(n_chars / len(string_split(text, chr(10))), 1) < 150 OR n_chars < 1500) THEN 'low_coverage' ELSE 'usable' END AS q FROM documents),
g AS (SELECT source, f.*, row_number() OVER (PARTITION BY source, field ORDER BY CASE confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, f.doc_id) AS r
      FROM f JOIN d USING (doc_id) WHERE q = 'usable' AND (role = 'pcap' AND field IN ({_LISTS["pcap"]}) OR role = 'ppt' AND field IN ({_LISTS["ppt"]}))),
s AS (SELECT source, bool_or(coalesce(q IN ('empty', 'low_coverage'), false)) AS any_ocr, count(q) > 0 AND count(*) FILTER (q = 'usable') = 0 AS no_text, count(q) > 0 AS docs, count(*) FILTER (q <> 'missing') > 0 AS texts FROM d GROUP BY source),
e AS (SELECT source, field, value, doc_id, any_ocr, no_text, CASE WHEN value IS NULL THEN CASE WHEN no_text THEN 'ocr_needed' WHEN any_ocr THEN 'manual_review_recommended' ELSE 'not_found' END WHEN only_pointer THEN 'evidence_only'
        WHEN confidence = 'high' THEN 'extracted' ELSE 'partial' END AS field_status FROM s CROSS JOIN (SELECT DISTINCT field FROM v) LEFT JOIN (SELECT * FROM g WHERE r = 1) USING (source, field))"""


def _records(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    role = F.when(F.col("doc_id") % 3 == 0, "pcap").when(F.col("doc_id") % 3 == 1, "ppt").otherwise("acta")
    rows = docs.select(
        "source", F.col("doc_id").alias("position"), role.alias("role"), "text", F.col("n_chars").alias("chars"), F.size(F.split("text", "\n")).alias("pages"),
        F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string")).alias("url"), F.lit("").alias("final_url"), F.lit("").alias("label"),
    )
    return A.record_fields(rows, "source", VARIANTS, ROLES, CORE)


@query(f"WITH {_RECORDS} SELECT source, field, field_status, value, doc_id AS position, CASE WHEN value IS NULL THEN CASE WHEN no_text THEN 'ocr_needed' WHEN any_ocr THEN 'manual_review' ELSE 'open_source_document' END END AS mode FROM e")
def record_fields(spark, sf_dir):
    """Fields of records with the way out for those that are missing; sources stand for records."""
    return _records(spark, sf_dir)[0].select("source", "field", "field_status", "value", "position", F.col("fallback.mode").alias("mode"))


@query(f"""WITH {_RECORDS}, z AS (SELECT source, count(value) AS fields_extracted, count(*) - count(value) AS fields_missing, count(*) FILTER (field IN ({", ".join(f"'{c}'" for c in CORE)}) AND field_status IN ('extracted', 'partial')) AS core,
  bool_or(field_status = 'evidence_only') AS pointer FROM e GROUP BY source)
SELECT source, CASE WHEN no_text OR NOT docs THEN CASE WHEN texts THEN 'ocr_needed' ELSE 'failed' END WHEN fields_extracted = 0 THEN 'source_link_only' WHEN core >= 4 AND NOT any_ocr THEN 'parsed' ELSE 'partial' END AS record_status, fields_extracted, fields_missing,
  array_to_string(list_filter([CASE WHEN fields_extracted = 0 THEN 'field_not_found' END, CASE WHEN fields_extracted = 0 THEN 'manual_review_recommended' END, CASE WHEN any_ocr THEN 'ocr_needed' END, CASE WHEN pointer THEN 'only_pointer_found' END,
    CASE WHEN no_text THEN 'text_low_coverage' END], lambda w: w IS NOT NULL), ',') AS warnings, any_ocr OR no_text AS ocr_needed FROM z JOIN s USING (source)""")
def record_status(spark, sf_dir):
    return _records(spark, sf_dir)[1].select("source", "record_status", "fields_extracted", "fields_missing", F.array_join("warnings", ",").alias("warnings"), "ocr_needed")


_NOTICES = """o AS (SELECT o_custkey, o_orderkey, floor(o_totalprice)::BIGINT AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS num FROM orders),
n AS (SELECT c_custkey, c_name, c_mktsegment, c_nationkey, floor(abs(c_acctbal))::BIGINT AS worth, count(o_orderkey) AS lots, '[' || string_agg('{"num":' || num || ',"descripcion":"Pedido ' || o_orderkey || '","valor_estimado":' || CASE WHEN o_orderkey % 4 = 0 THEN 'null' ELSE price || '.0' END || '}', ',' ORDER BY num) || ']' AS list
      FROM customer LEFT JOIN o ON o_custkey = c_custkey GROUP BY ALL)"""


def _notices(spark, sf_dir):
    """A notice of each customer: its segment is the subject, its orders are lots."""
    price = F.floor("o_totalprice").cast("long").cast("string")
    lot = F.concat(F.lit("\nLote %d: Pedido "), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 4 == 0, "\nsin valor").otherwise(F.concat(F.lit("\nValor estimado del contrato "), price, F.lit(" EUR"))))
    lots = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", lot.alias("lot")))).alias("lots"))
    worth = F.floor(F.abs("c_acctbal")).cast("long").cast("string")
    text = F.concat(
        F.lit("Anuncio de licitación\nNúmero de Expediente "), F.col("c_name"), F.lit("\nObjeto del Contrato: "), F.col("c_mktsegment"), F.lit("\n--- PAGE 2 ---\nPresupuesto base de licitación\nImporte (sin impuestos) "), worth,
        F.lit(" EUR\nClasificación CPV\n7934000"), (F.col("c_nationkey") % 10).cast("string"), F.lit(" - Publicidad.\nProcedimiento Abierto\nNombre\nSubtipo Criterio : Otros\nPonderación : "), F.col("c_nationkey").cast("string"),
        F.coalesce(F.array_join(F.transform("lots", lambda x, i: F.replace(x["lot"], F.lit("%d"), (i + 1).cast("string"))), ""), F.lit("")),
    )
    return load(spark, sf_dir, "customer").join(lots, "c_custkey", "left").select("c_custkey", text.alias("text"))


@query(f"""WITH {_NOTICES} SELECT c_custkey, field, value, page FROM (
  SELECT c_custkey, unnest(['objeto', 'contract_meta', 'presupuesto_base', 'cpv', 'criterios_adjudicacion', 'criterios_tecnicos', 'lotes', 'opportunity_flags']) AS field,
    unnest([c_mktsegment, '{{"num_expediente":"' || c_name || '","procedimiento":"Abierto"}}',
      '{{"importe_con_impuestos":null,"importe_sin_impuestos":' || worth || '.0' || ',"currency":"EUR"}}', '[{{"code":"7934000' || (c_nationkey % 10) || '","label":"Publicidad"}}]',
      '[{{"nombre":"Nombre","subtipo":"Otros","ponderacion":' || c_nationkey || '}}]', '[{{"nombre":"Nombre","ponderacion":' || c_nationkey || '}}]', list,
      '{{"es_sda":false,"procedimiento_restringido":false,"sujeto_regulacion_armonizada":false,"fondos_ue":null,"num_lotes":' || CASE WHEN lots > 0 THEN lots::VARCHAR ELSE 'null' END || ',"deadline_valid":false}}']) AS value,
    unnest([1, 1, 2, 2, 2, 2, 1, 1]) AS page FROM n) WHERE value IS NOT NULL""")
def notice_fields(spark, sf_dir):
    """The fields of notices; customers with their orders stand for notices with lots."""
    found = N.notice_fields(_notices(spark, sf_dir), ["c_custkey"], "text").where("value IS NOT NULL AND field <> 'valor_estimado'")
    return found.select("c_custkey", "field", "value", "page")


@query(f"""WITH {_NOTICES} SELECT c_custkey, round((7 + CASE WHEN lots > 0 THEN 1 ELSE 0 END + CASE WHEN list LIKE '%.0%' THEN 1 ELSE 0 END) / 12, 3) AS coverage, 'partial' AS appendix_status FROM n""")
def appendix_status(spark, sf_dir):
    return N.appendix_status(N.notice_fields(_notices(spark, sf_dir), ["c_custkey"], "text", brief=True), ["c_custkey"])
