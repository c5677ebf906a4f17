"""Queries that sum up runs: discovery, resolution, gates, merges, documents, discards. Events stand for candidates and customers for records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates as G
from ..operators import records as R
from ..operators import summaries as S
from ..sources.tables import load
from .persistence import _TABLES as _PLAN
from .persistence import _tables as _plan_tables
from .registry import query

_LINKS = """c AS (SELECT event_id AS position, event_type || ' ' || (user_id % 40) AS title, CASE WHEN value < 30 THEN 'low' WHEN value < 60 THEN 'medium' WHEN value < 99 THEN 'high' END AS confidence, CASE WHEN value > 4 THEN event_type END AS kind,
    CASE WHEN value > 95 THEN 'gateway' ELSE 'pdf' END AS extension, 'h' || (user_id % 7) || '.es' AS source_domain, CASE WHEN value < 2 THEN 'Ver' WHEN value < 4 THEN ' documento PDF ' WHEN value < 5 THEN 'aviso  legal' ELSE event_type || ' ' || (user_id % 40) END AS shown, user_id, value FROM events),
r AS (SELECT c_custkey, count(user_id) AS kept, CASE WHEN c_acctbal < -900 THEN 'timeout' END AS error, c_acctbal > 9900 AS capped FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY ALL)"""


def _links(spark, sf_dir):
    v, kind = F.col("value"), F.col("event_type")
    plain = F.concat_ws(" ", kind, (F.col("user_id") % 40).cast("string"))
    candidates = load(spark, sf_dir, "events").select(
        F.col("event_id").alias("position"), F.when(v < 2, "Ver").when(v < 4, " documento PDF ").when(v < 5, "aviso  legal").otherwise(plain).alias("title"), F.when(v < 30, "low").when(v < 60, "medium").when(v < 99, "high").alias("confidence"),
        F.when(v > 4, kind).alias("kind"), F.when(v > 95, "gateway").otherwise("pdf").alias("extension"), F.concat(F.lit("h"), (F.col("user_id") % 7).cast("string"), F.lit(".es")).alias("source_domain"), "user_id", "value",
    )
    kept = candidates.groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("kept"))
    records = load(spark, sf_dir, "customer").join(kept, "c_custkey", "left").select(
        F.coalesce("kept", F.lit(0)).alias("kept"), (F.coalesce("kept", F.lit(0)) + 2).alias("before_filter"), F.when(F.col("c_acctbal") < -900, "timeout").alias("error"), (F.col("c_acctbal") > 9900).alias("capped"), F.lit(1).cast("long").alias("duplicates"),
        F.create_map(F.lit("nav"), F.lit(1).cast("bigint"), F.col("c_mktsegment"), F.lit(2).cast("bigint")).alias("skipped"),
    )
    return candidates, records


def _top(measure: str, value: str, k: int, table: str, where: str = "true") -> str:
    return f"SELECT 'top' AS section, '{measure}' AS measure, {value} AS value, row_number() OVER (ORDER BY count(*) DESC, min(position), {value})::INT AS place, count(*)::DOUBLE AS n FROM {table} WHERE {where} GROUP BY {value} QUALIFY place <= {k}"


def _hist(measure: str, value: str, table: str, where: str = "true") -> str:
    return f"SELECT 'histogram' AS section, '{measure}' AS measure, {value} AS value, NULL::INT AS place, count(*)::DOUBLE AS n FROM {table} WHERE {where} GROUP BY {value}"


def _counts(table: str, **counts: str) -> str:
    return " UNION ALL ".join(f"SELECT 'count' AS section, '{m}' AS measure, NULL AS value, NULL::INT AS place, count(*)::DOUBLE AS n FROM {table} WHERE {c} HAVING count(*) > 0" for m, c in counts.items())


def _all(*parts: str) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


_GENERIC = "lower(trim(shown)) IN ('ver', 'documento html', 'documento xml', 'documento pdf', 'deferred modules')"
_NAV = "lower(regexp_replace(trim(shown), '\\s+', ' ', 'g')) = 'aviso legal'"


@query(f"""WITH {_LINKS} {_all(_top("title", "trim(shown)", 15, "c"), _hist("confidence", "coalesce(confidence, 'low')", "c"), _hist("kind", "coalesce(kind, 'unknown')", "c"), _hist("extension", "extension", "c"), _hist("source_domain", "source_domain", "c"),
  _counts("c", candidates_after_filter="true", generic_title_count=_GENERIC, nav_title_count=_NAV),
  "SELECT 'histogram' AS section, 'skipped' AS measure, k AS value, NULL::INT AS place, sum(n)::DOUBLE AS n FROM (SELECT 'nav' AS k, count(*) AS n FROM customer UNION ALL SELECT c_mktsegment, 2 * count(*) FROM customer GROUP BY 1) GROUP BY k")}""")
def link_histograms(spark, sf_dir):
    """All histograms and counts of a discovery run."""
    candidates, records = _links(spark, sf_dir)
    return S.link_summary(candidates, records, ("aviso legal",))[0]


@query(f"""WITH {_LINKS}, q AS (SELECT count(*) AS records_attempted, count(*) FILTER (kept > 0) AS records_with_candidates, (sum(kept) + 2 * count(*))::BIGINT AS candidates_before_filter, count(error) AS error_count, count(*) FILTER (capped) AS capped_records_count, count(*) AS duplicate_url_count FROM r),
x AS (SELECT count(*) AS candidates_after_filter, count(*) FILTER ({_GENERIC}) AS generic_title_count, count(*) FILTER ({_NAV}) AS nav_title_count FROM c)
SELECT *, round(error_count / records_attempted, 6) AS error_rate, round(records_with_candidates / records_attempted, 6) AS records_with_candidates_ratio, round(generic_title_count / candidates_after_filter, 6) AS generic_title_ratio FROM q, x""")
def link_counts(spark, sf_dir):
    candidates, records = _links(spark, sf_dir)
    return S.link_summary(candidates, records, ("aviso legal",))[1]


_RESOLVED = """c AS (SELECT event_id AS position, CASE WHEN value > 98 THEN NULL WHEN value > 10 THEN 'resolved' WHEN value > 6 THEN 'unresolved' WHEN value > 3 THEN 'error' ELSE 'skipped' END AS status, 'h' || (user_id % 11) AS source_domain,
    CASE WHEN value > 20 THEN 'f' || (user_id % 5) ELSE '' END AS final_domain, CASE event_type WHEN 'click' THEN 'text/html' WHEN 'view' THEN 'application/pdf' ELSE '' END AS ct, CASE WHEN value > 50 THEN 'pdf' ELSE '' END AS extension, event_type AS method,
    CASE WHEN value > 30 THEN 'pliego' || (user_id % 90) || '.pdf' END AS filename, CASE WHEN value < 10 THEN 'E' || (event_id % 13) END AS error_type, value, event_type FROM events)"""


def _resolved(spark, sf_dir):
    v, kind, user = F.col("value"), F.col("event_type"), F.col("user_id")
    text = lambda p, n, end="": F.concat(F.lit(p), n.cast("string"), F.lit(end))
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("position"), F.when(v > 98, None).when(v > 10, "resolved").when(v > 6, "unresolved").when(v > 3, "error").otherwise("skipped").alias("status"), (v > 50).alias("is_pdf"), (v > 40).alias("is_document"),
        (kind == "purchase").alias("merge_ready"), text("h", user % 11).alias("source_domain"), F.when(v > 20, text("f", user % 5)).otherwise("").alias("final_domain"),
        F.when(kind == "click", "text/HTML ; charset=utf-8").when(kind == "view", "application/pdf").alias("content_type"), F.when(v > 50, "pdf").alias("extension"), kind.alias("method"), F.when(v > 30, text("pliego", user % 90, ".pdf")).alias("filename"),
        F.when(v < 10, text("E", F.col("event_id") % 13)).alias("error_type"),
    )


@query(f"""WITH {_RESOLVED} {_all(_top("filename", "filename", 15, "c", "filename IS NOT NULL"), _top("error_type", "error_type", 10, "c", "error_type IS NOT NULL"), _hist("per_domain", "source_domain", "c"), _hist("per_domain_resolved", "source_domain", "c", "status = 'resolved'"),
  _hist("final_domain", "final_domain", "c", "final_domain <> ''"), _hist("content_type", "ct", "c"), _hist("inferred_extension", "extension", "c"), _hist("resolver_method", "method", "c"), _hist("resolver_status", "coalesce(status, '')", "c"),
  _counts("c", candidates_attempted="true", resolved_count="status = 'resolved'", unresolved_count="status = 'unresolved'", error_count="status IN ('error', 'skipped')", resolved_pdf_count="value > 50", resolved_document_count="value > 40", merge_ready_candidate_count="event_type = 'purchase'",
          unresolved_after_resolver_count="status IN ('unresolved', 'error', 'skipped')"))}""")
def resolver_histograms(spark, sf_dir):
    """All histograms, top lists and counts of a resolver run."""
    return S.resolver_report(_resolved(spark, sf_dir))[0]


@query(f"""WITH {_RESOLVED}, x AS (SELECT count(*) AS candidates_attempted, count(*) FILTER (status = 'resolved') AS resolved_count, count(*) FILTER (status = 'unresolved') AS unresolved_count, count(*) FILTER (status IN ('error', 'skipped')) AS error_count,
  count(*) FILTER (value > 50) AS resolved_pdf_count, count(*) FILTER (value > 40) AS resolved_document_count, count(*) FILTER (event_type = 'purchase') AS merge_ready_candidate_count, count(*) FILTER (status IN ('unresolved', 'error', 'skipped')) AS unresolved_after_resolver_count FROM c)
SELECT *, round(error_count / candidates_attempted, 6) AS resolver_error_rate, round(resolved_count / candidates_attempted, 6) AS resolved_ratio, round(resolved_pdf_count / candidates_attempted, 6) AS resolved_pdf_ratio,
  round(resolved_document_count / candidates_attempted, 6) AS resolved_document_ratio, round(merge_ready_candidate_count / candidates_attempted, 6) AS merge_ready_candidate_ratio FROM x""")
def resolver_counts(spark, sf_dir):
    return S.resolver_report(_resolved(spark, sf_dir))[1]


_REQUIRED = ("candidate_id", "kind", "confidence")


def _gate(spark, sf_dir, stated=None):
    candidates, records = _links(spark, sf_dir)
    fields = F.when(F.col("value") < 97, F.array(*map(F.lit, _REQUIRED))).otherwise(F.array(F.lit("kind")))
    rows = candidates.withColumns({"normalized_title": F.trim("title"), "needs_resolver": F.col("value") > 99.5, "merge_ready": F.col("value") > 50, "fields": fields})
    return S.gate_measures(rows, records, _REQUIRED, ("click 3", "view 7"), stated)


_MEASURES = f"""x AS (SELECT count(*) AS a, count(*) FILTER ({_GENERIC}) AS g, count(*) FILTER (lower(trim(shown)) IN ('click 3', 'view 7')) AS nl, count(*) FILTER (extension = 'gateway' OR value > 99.5) AS ug, count(*) FILTER (kind = 'unknown') AS uk,
  count(*) FILTER (confidence = 'high') AS hi, count(*) FILTER (confidence = 'medium') AS me, count(*) FILTER (confidence = 'low') AS lo, count(*) FILTER (value >= 97) AS mf, count(*) FILTER (value > 50) AS rt FROM c),
q AS (SELECT count(*) AS ra, count(*) FILTER (kept > 0) AS rc, count(error) AS ec FROM r),
m AS (SELECT ra AS records_attempted, rc AS records_with_candidates, ec AS error_count, 4 AS nav_title_count, a AS candidates_after_filter, g AS generic_title_count, nl AS nav_like_survivor_count, ug AS unresolved_gateway_count, uk AS unknown_kind_count, hi AS high_confidence_count,
  me AS medium_confidence_count, lo AS low_confidence_count, mf AS missing_v2_field_count, rt AS merge_ready_true_count, a - rt AS merge_ready_false_count, 2 * a AS candidates_before_filter, round(rc / ra, 6) AS records_with_candidates_ratio, round(g / a, 6) AS generic_title_ratio,
  round(ug / a, 6) AS unresolved_gateway_ratio, round(uk / a, 6) AS unknown_kind_ratio, round(hi / a, 6) AS high_confidence_ratio, round(ec / ra, 8) AS error_rate FROM x, q)"""


def _stated(spark, sf_dir):
    """What a manifest says: numbers that go before the computed ones."""
    return load(spark, sf_dir, "events").agg((2 * F.count("*")).alias("candidates_before_filter"), F.lit(4).cast("long").alias("nav_title_count"), F.lit(None).cast("long").alias("error_count"))


@query(f"WITH {_LINKS}, {_MEASURES} SELECT * FROM m")
def gate_measures(spark, sf_dir):
    """The measures of a quality gate, the manifest's own numbers first."""
    return _gate(spark, sf_dir, _stated(spark, sf_dir))[1]


@query(f"""WITH {_LINKS}, {_MEASURES} SELECT CASE WHEN error_rate > 0.05 OR candidates_after_filter = 0 THEN 'FAIL' ELSE 'PASS' END AS artifact_status, array_to_string(list_filter([CASE WHEN error_rate > 0.05 THEN 'artifact' END, CASE WHEN error_rate > 0.01 THEN 'error_rate' END,
  CASE WHEN generic_title_ratio > 0.1 THEN 'generic_titles' END, CASE WHEN unresolved_gateway_ratio > 0.1 THEN 'unresolved_gateways' END, CASE WHEN nav_title_count > 0 THEN 'nav_titles' END, CASE WHEN nav_like_survivor_count > 0 THEN 'nav_like' END,
  CASE WHEN unknown_kind_ratio > 0.05 THEN 'unknown_kinds' END, CASE WHEN missing_v2_field_count > 0 THEN 'missing_fields' END, CASE WHEN merge_ready_true_count = 0 THEN 'none_ready' END], lambda w: w IS NOT NULL), ',') AS blocking FROM m""")
def gate_verdict(spark, sf_dir):
    """The verdicts on the measures, from the gate's own rows alone."""
    m = G.quality_verdicts(_gate(spark, sf_dir, _stated(spark, sf_dir))[1])
    return m.select("artifact_status", F.array_join("merge_blocking", ",").alias("blocking"))


@query(f"""WITH {_LINKS}, f AS (SELECT unnest(list_filter([CASE WHEN {_GENERIC} THEN 'generic_title' END, CASE WHEN extension = 'gateway' THEN 'gateway' END, CASE WHEN kind IS NULL THEN 'no_kind' END], lambda k: k IS NOT NULL)) AS kind, position, shown AS title FROM c)
SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY kind ORDER BY position) <= 20""")
def gate_samples(spark, sf_dir):
    candidates = _links(spark, sf_dir)[0].withColumnRenamed("kind", "link_kind")
    generic = F.lower(F.trim("title")).isin(*S.GENERIC_TITLES)
    return S.samples(candidates, {"generic_title": generic, "gateway": F.col("extension") == "gateway", "no_kind": F.col("link_kind").isNull()}, ["title"], "position")


_PERSISTED = f"""{_PLAN}, z AS (SELECT a.*, n, nr, nk, CASE WHEN url = '' THEN 'missing_final_url' WHEN pos % 9 = 0 THEN 'not_document' WHEN pos % 5 = 0 THEN 'not_merge_ready' WHEN a.record_id IS NULL THEN 'record_id_missing' END AS early,
    CASE WHEN n IS NULL THEN 'unmatched' WHEN n = 1 THEN 'id' WHEN nk = 1 THEN 'id_and_key' WHEN nr = 1 THEN 'enriched_copy' ELSE 'ambiguous' END AS jm FROM a LEFT JOIN i ON i.record_id = a.record_id LEFT JOIN k ON k.record_id = a.record_id AND k.key = a.key),
y AS (SELECT z.*, coalesce(early, CASE WHEN jm = 'unmatched' THEN 'record_not_found' WHEN jm = 'ambiguous' THEN 'ambiguous_record' WHEN e.url IS NOT NULL THEN 'existing_document_url' END) AS why FROM z LEFT JOIN e ON e.record_id = z.record_id AND e.url = z.url),
x AS (SELECT *, CASE WHEN why IS NULL AND row_number() OVER (PARTITION BY record_id, url, why IS NULL ORDER BY pos) > 1 THEN CASE WHEN jm = 'enriched_copy' THEN 'duplicate_evidence_final_url' ELSE 'duplicate_final_url' END ELSE why END AS reason FROM y),
c0 AS (SELECT *, pos AS position, reason IN ('duplicate_final_url', 'duplicate_evidence_final_url', 'existing_document_url') AS dbl, early IS NULL AS reached FROM x)"""


def _persisted(spark, sf_dir):
    accepted, records, existing = _plan_tables(spark, sf_dir)
    pos = F.col("pos")
    candidates = accepted.withColumn("canonical_key", F.when(F.col("canonical_key") == "", "-").otherwise(F.col("canonical_key"))).select(
        "pos", pos.cast("string").alias("candidate_id"), "record_id", "canonical_key", F.col("url").alias("final_url"), F.lit("application/pdf").alias("content_type"), (pos % 9 != 0).alias("is_document"), (pos % 5 != 0).alias("ready"), F.array().cast("array<string>").alias("blockers")
    )
    return R.persistence(candidates, records, existing)


@query(f"""WITH {_PERSISTED} {_all(_hist("reason", "coalesce(reason, 'accepted')", "c0"), _hist("join_method", "jm", "c0", "reached"), _hist("duplicate_join_method", "jm", "c0", "dbl"), _hist("blocked_reason", "reason", "c0", "reason IS NOT NULL AND NOT dbl"),
  _counts("c0", resolved_seen="true", merge_ready_seen="pos % 5 <> 0", accepted_documents="reason IS NULL", duplicates="dbl", blocked_documents="reason IS NOT NULL AND NOT dbl", duplicate_evidence_rows="reason = 'duplicate_evidence_final_url'", html_non_doc_blocked="reason = 'not_document'",
          production_records_matched="reached AND jm IN ('id', 'id_and_key', 'enriched_copy')", production_records_missing="reason = 'record_not_found'", ambiguous_record_join_remaining="reason = 'ambiguous_record'", unmatched_rows="reason IN ('record_not_found', 'ambiguous_record', 'record_id_missing')",
          resolved_via_strict_id="reached AND jm = 'id'", resolved_via_strict_id_canonical_key="reached AND jm = 'id_and_key'", resolved_via_enriched_fallback="reached AND jm = 'enriched_copy'"))}""")
def merge_histograms(spark, sf_dir):
    """Reasons, join methods and counts of a merge."""
    return S.merge_report(_persisted(spark, sf_dir))[0]


_STATES = ("extracted", "partial_parse", "text_empty", "unsupported_type", "download_failed", "too_large", "timeout", "parse_failed")
_DOCS = f"""c AS (SELECT doc_id, lang AS role, source, (['selected_only', {", ".join(f"'{s}'" for s in _STATES)}])[doc_id % 9 + 1] AS state, n_chars < 300 AS ocr, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'pdf' WHEN 2 THEN 'docx' ELSE 'zip' END AS kind FROM documents),
r AS (SELECT source, CASE WHEN count(*) > 20 THEN 'parsed' WHEN count(*) > 10 THEN 'partial' ELSE 'source_link_only' END AS status FROM documents GROUP BY 1)"""


@query(f"""WITH {_DOCS} {_all(_hist("role", "role", "c", "role <> ''"), _hist("detected_type", "kind", "c", "kind <> ''"), _hist("extraction_status", "state", "c"), _hist("record_status", "status", "r"),
  _counts("c", documents="true", attempted="state <> 'selected_only'", **{s: f"state = '{s}'" for s in _STATES}, ocr_needed_documents="ocr"), _counts("r", records="true", source_link_only_records="status = 'source_link_only'"))}""")
def document_histograms(spark, sf_dir):
    """Roles, types and states of documents and records; documents by language and source stand for them."""
    docs = load(spark, sf_dir, "documents")
    state = F.element_at(F.array(*map(F.lit, ("selected_only", *_STATES))), (F.col("doc_id") % 9 + 1).cast("int"))
    kind = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 5 == 1, "pdf").when(F.col("doc_id") % 5 == 2, "docx").otherwise("zip")
    rows = docs.select(F.col("lang").alias("role"), kind.alias("detected_type"), state.alias("extraction_status"), (F.col("n_chars") < 300).alias("ocr_needed"))
    n = F.count("*")
    records = docs.groupBy("source").agg(F.when(n > 20, "parsed").when(n > 10, "partial").otherwise("source_link_only").alias("record_status"))
    return S.document_report(rows, records)[0]


_FEED = """f AS (SELECT o_orderkey AS position, 'e' || (o_orderkey % 9001) AS ident, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'Diseño  gráfico de ' WHEN '2-HIGH' THEN 'Branding y logotipo ' WHEN '3-MEDIUM' THEN 'Catering y branding ' WHEN '4-NOT SPECIFIED' THEN 'Impresión de ' ELSE 'Obra ' END || o_custkey END AS title,
    CASE o_orderstatus WHEN 'F' THEN 'diseño gráfico con marca' WHEN 'O' THEN 'obra civil' ELSE '' END AS content, CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END AS design, o_orderpriority AS p, o_orderstatus AS s FROM orders),
g AS (SELECT *, p IN ('1-URGENT', '2-HIGH', '4-NOT SPECIFIED') AS gate, CASE p WHEN '1-URGENT' THEN 15 WHEN '2-HIGH' THEN 25 WHEN '3-MEDIUM' THEN 15 WHEN '4-NOT SPECIFIED' THEN 15 ELSE -5 END AS t FROM f WHERE title IS NOT NULL UNION ALL SELECT *, false, -5 FROM f WHERE title IS NULL),
h AS (SELECT *, t + CASE WHEN s = 'F' THEN 10 ELSE 0 END AS b FROM g),
k AS (SELECT *, greatest(0, least(100, b + CASE WHEN design = 1 AND b > 0 THEN 20 ELSE 0 END)) AS score FROM h),
w AS (SELECT *, min(CASE WHEN gate AND score >= 26 THEN position END) OVER (PARTITION BY ident) AS first FROM k),
c AS (SELECT *, CASE WHEN title IS NULL THEN 'no_title' WHEN NOT gate THEN 'title_gate' WHEN position > first THEN 'dup' WHEN score < 26 THEN 'low_score' END AS reason FROM w)"""


def _feed(spark, sf_dir):
    key, cust, p, s = (F.col(c) for c in ("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"))
    start = F.when(p == "1-URGENT", "Diseño  gráfico de ").when(p == "2-HIGH", "Branding y logotipo ").when(p == "3-MEDIUM", "Catering y branding ").when(p == "4-NOT SPECIFIED", "Impresión de ").otherwise("Obra ")
    entries = load(spark, sf_dir, "orders").select(
        key.alias("position"), F.concat(F.lit("e"), (key % 9001).cast("string")).alias("ident"), F.when(key % 17 != 0, F.concat(start, cust.cast("string"))).alias("title"),
        F.when(s == "F", "diseño gráfico con marca").when(s == "O", "obra civil").otherwise("").alias("content"), F.when(cust % 3 == 0, F.array(F.lit("79340000"))).alias("cpv"),
    )
    rows = S.discard_reasons(entries, 26)
    return S.discards(rows, F.col("reason"), F.col("score"), "position", ["ident", "title"])


@query(f"""WITH {_FEED} {_all(_hist("low_score_by_score", "score::VARCHAR", "c", "reason = 'low_score'"),
  _counts("c", observed_entries_count="true", candidate_id_count="coalesce(reason, '') NOT IN ('no_title', 'title_gate')", accepted_count="reason IS NULL", discarded_count="reason IS NOT NULL", **{r: f"reason = '{r}'" for r in ("no_title", "title_gate", "low_score", "dup")}))}""")
def discard_histograms(spark, sf_dir):
    """Why entries of a feed are not taken, by the real gate and score; titles are made of orders."""
    return _feed(spark, sf_dir)[0]


@query(f"WITH {_FEED} SELECT reason, score::INT AS score, position, ident, title FROM c WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY reason ORDER BY position) <= 500")
def discard_evidence(spark, sf_dir):
    """The first 500 entries of each reason."""
    return _feed(spark, sf_dir)[1]
