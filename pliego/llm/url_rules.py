"""Operator 11: URL filters. Pattern rules are indexed by their rarest literal token.

DataFrame functions only. A rule is a pattern over host and path in the syntax of filter lists:
``||`` begins at the host or one of its labels, ``|`` stands for the beginning or the end, ``*``
for any text, ``^`` for a separator or an end; all else is literal. Its literal tokens are the
runs of letters and digits that stand whole in every match. Over all urls the rule tokens
are counted, each rule is filed under its rarest one, the tokens of a url fetch the rules filed
under them, and only those run their regular expressions.

Up to INLINE rules, the index is a constant of the query: judging a url is a projection and
moves no rows. Above, the index is a table that the tokens are joined to.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import salted_join, whole_row, written

#: So many rules at most are written into the query; more are joined.
INLINE = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between tokens: all of ASCII but letters and digits.
_GAP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_FIELDS = "level int, length int, name string, verdict string, regex string"


class Rule(NamedTuple):
    """level: rules of a higher one go first; among equals the longest name wins, then the last by code point."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    level: int = 0


def _in_token(sign: str) -> bool:
    return not sign.isascii() or sign.isalnum()


def pattern(text: str, verdict: str = "block", level: int = 0, name: str | None = None) -> Rule:
    """The rule of a pattern. A run of letters and digits is a literal token of the rule if
    the pattern itself ends it on both sides, so that no match can continue it."""
    rest, parts, tokens, run, whole = text, [], [], "", False
    for sign, regex in (("||", r"^(?:[^/]*\.)?"), ("|", "^")):
        if rest.startswith(sign):
            rest, whole = rest[len(sign) :], True
            parts.append(regex)
            break
    closed = rest.endswith("|")
    rest = rest[:-1] if closed else rest
    for sign in rest:
        if _in_token(sign) and sign not in "*^":
            run += sign
            parts.append(re.escape(sign))
            continue
        if run and whole and sign != "*":
            tokens.append(run)
        run, whole = "", sign != "*"
        parts.append(".*" if sign == "*" else f"(?:^|[{_GAP}]|$)" if sign == "^" else re.escape(sign))
    if run and whole and closed:
        tokens.append(run)
    parts.append("$" if closed else "")
    return Rule(name or text, verdict, "(?s)" + "".join(parts), tuple(sorted({t.translate(str.maketrans(_UPPER, _LOWER)) for t in tokens})), level)


def site(verdict: str, place: str) -> Rule:
    """The rule of a host with all its subdomains, and of the paths that begin as given: ``example.com/en/``."""
    return pattern(f"||{place}", verdict, level=1, name=place)


#: The rules on places.
SITES = (site("allow", "com/"), site("block", "example.com/en/"), site("allow", "www.example.com/en/"), site("block", "net/es/"), site("block", "net/fr/"))
#: Patterns of advertisers' and machine-made pages; they judge urls that no place rule fits.
PATTERNS = tuple(
    pattern(x)
    for x in ("^casino^", "^poker^", "^bets^", "^betting^", "^pills^", "^viagra^", "^porn^", "^xxx^", "^payday^", "^torrent^", "/cgi-bin/", "/wp-admin/", "/tag/*/page/", ".exe|", ".zip|", "^doubleclick^")
)


def _lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.substr(url, mark + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return _lowered(host), path


def _tokens(subject: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(_lowered(subject), F.lit(f"[^{_GAP}]+"), F.lit(0)))


def _filed(subjects: DataFrame, rules: Sequence[Rule]) -> list[tuple[str, int, list[Rule]]]:
    """(token, number of subjects with it, rules filed under it); rules without a token lie under the empty one, which all subjects have."""
    spark = subjects.sparkSession
    wanted = sorted({t for r in rules for t in r.tokens})
    held = subjects.select(F.explode("tokens").alias("token"))
    if len(wanted) <= INLINE:
        held = held.where(F.col("token").isin(wanted))
    else:
        held = held.join(spark.createDataFrame([(t,) for t in wanted], "token string"), "token", "left_semi")
    counts = {t: n for t, n in held.groupBy("token").count().collect()}  # one row for each token of the rules at most
    under: dict[str, list[Rule]] = {}
    for rule in rules:
        under.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(rule)
    return [(t, counts.get(t, 0), held_by) for t, held_by in sorted(under.items())]


def _candidate(rule: Rule) -> Column:
    return F.struct(F.lit(rule.level).alias("level"), F.lit(len(rule.name)).alias("length"), F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"), F.lit(rule.regex).alias("regex"))


def _inline(rows: DataFrame, filed: list[tuple[str, int, list[Rule]]]) -> DataFrame:
    always = [r for t, _, held in filed if not t for r in held]
    under = [(t, held) for t, _, held in filed if t]
    found = F.array(*map(_candidate, always)).cast(f"array<struct<{_FIELDS.replace(' ', ':')}>>".replace(",:", ","))
    if under:
        index = F.create_map(*(x for t, held in under for x in (F.lit(t), F.array(*map(_candidate, held)))))
        fetched = F.transform(F.array_intersect("tokens", F.array(*(F.lit(t) for t, _ in under))), lambda t: index[t])
        found = F.concat(found, F.flatten(fetched))
    hits = F.filter(found, lambda r: F.rlike(F.col("subject"), r["regex"]))
    return rows.withColumn("best", F.array_max(hits))


def _joined(rows: DataFrame, filed: list[tuple[str, int, list[Rule]]]) -> DataFrame:
    """As _inline with the index as a table; a token that many subjects have is dealt over tasks, and so is a subject that many rows have."""
    spark = rows.sparkSession
    subjects = written(rows.groupBy("subject").agg(F.count("*").alias("n")))
    total, distinct = subjects.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    entries = [(t, n if t else distinct, r.level, len(r.name), r.name, r.verdict, r.regex) for t, n, held in filed for r in held]
    index = spark.createDataFrame(entries, f"token string, n long, {_FIELDS}")
    index = index.groupBy("token").agg(F.first("n").alias("n"), F.collect_list(F.struct(*[x.split()[0] for x in _FIELDS.split(", ")])).alias("rules"))
    keys = F.explode(F.concat(_tokens(F.col("subject")), F.array(F.lit("")))).alias("token")
    fetched = salted_join(subjects.select("subject", keys), index, ["token"], distinct, ["subject"]).select("subject", F.explode("rules").alias("r"))
    best = fetched.where(F.rlike("subject", F.col("r.regex"))).groupBy("subject").agg(F.max("r").alias("best"))
    judged = subjects.join(best, "subject", "left")
    return salted_join(rows, judged, ["subject"], total, ["url"] if "url" in rows.columns else ["row"])


def judged(pages: DataFrame, rules: Sequence[Rule] = SITES + PATTERNS, columns: list[str] | None = None, url_col: str = "url", default: str = "allow", inline: int = INLINE) -> DataFrame:
    """(row, host, path, rule, pattern, verdict), one row for each row of pages.

    ``row`` is a struct of the given columns of pages (all by default), so their names
    cannot clash. rule names the place rule (level 1) that decided, pattern another rule
    that did; with neither, the verdict is ``default``. A null url and one without ``://``
    have an empty host and path, which no place rule fits. Equal rows are judged alike and
    each comes back; an empty table gives an empty result. Long urls are read whole.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(whole_row(columns or pages.columns), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("subject", F.concat("host", "path")).withColumn("tokens", _tokens(F.col("subject")))
    filed = _filed(rows, rules)
    found = _inline(rows, filed) if len(rules) <= inline else _joined(rows, filed)
    level, name = F.col("best.level"), F.col("best.name")
    return found.select(
        "row", "host", "path", F.when(level > 0, name).alias("rule"), F.when(level == 0, name).alias("pattern"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


#: The query's rows for DuckDB: every rule on every url, without an index.
ORACLE_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw, coalesce(rest, '') AS rest FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) t(rh, rp, rv)),
f AS (SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
      FROM p LEFT JOIN r ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL),
b AS (SELECT *, host || path AS s FROM f),
v AS (SELECT page_id, host, path, rule, rv,
       CASE WHEN rule IS NULL THEN (SELECT arg_max(x, lpad(length(x)::VARCHAR, 4, '0') || x) FROM (SELECT unnest(list_filter(
         ['^casino^', '^poker^', '^bets^', '^betting^', '^pills^', '^viagra^', '^porn^', '^xxx^', '^payday^', '^torrent^', '^doubleclick^'],
         lambda w: regexp_matches(s, '(^|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])' || trim(w, '^') || '([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]|$)'))
         || list_filter(['/cgi-bin/', '/wp-admin/'], lambda w: contains(s, w)) || list_filter(['.exe|', '.zip|'], lambda w: suffix(s, w[:-2]))
         || list_filter(['/tag/*/page/'], lambda w: regexp_matches(s, '(?s)/tag/.*/page/'))) AS x)) END AS pattern FROM b)
SELECT page_id, host, path, rule, pattern, coalesce(rv, CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict FROM v
"""
