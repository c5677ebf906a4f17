"""Privacy scan: rules over keys and values of texts and JSON trees, severity by trust surface.

A tree becomes rows, one for each node, with the keys on the way to it. All rules are column
expressions over those rows; only the walk itself is Python, as it knows no depth.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contract import private_host
from ..functions.notices import let
from ..functions.semantics import fold_accents, tax_id_valid
from . import privacy_tables as T
from .privacy_tables import HARD, HYGIENE, PATTERNS, PUBLIC


def severity(rule: Column, surface: str) -> Column:
    """ERROR, WARN, or null where a rule is suppressed on a surface."""
    public = F.lit(surface in ("public-build", "public-diagnostic"))
    return F.when(rule.isin(*HARD), "ERROR").when(rule.isin(*PUBLIC) & public, "ERROR").when(rule.isin(*HYGIENE) & F.lit(surface == "public-build"), "WARN")


#: Texts of which a value must have one for a pattern to match: a cheap test before the pattern.
_NEEDS = {
    "EMAIL_VALUE": ("@",), "PRIVATE_KEY_BLOCK": ("-----BEGIN ",), "CONTACT_VALUE": ("+",), "WINDOWS_ABS_PATH": (":\\", ":/"), "UNC_PATH": ("\\\\",),
    "UNIX_HOME_PATH": ("/home/", "/Users/", "/root/"), "CREDENTIAL_VALUE": (":", "=", "Bearer", "AKIA", "ghp_", "github_pat_", "xox"),
}
#: Patterns that hold for the same values and are found faster: one sign before the @ is enough.
_FASTER = {"EMAIL_VALUE": r"[A-Za-z0-9._%+\-]@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"}


def breaks(value: Column, rule: str, pattern: str) -> Column:
    """Whether a value matches a pattern of PATTERNS, or one of the caller's."""
    hit = value.rlike(_FASTER.get(rule, pattern) if PATTERNS.get(rule) == pattern else pattern)
    if PATTERNS.get(rule) != pattern or rule not in _NEEDS:
        return hit
    needs = [value.contains(x) for x in _NEEDS[rule]]
    some = needs[0]
    for n in needs[1:]:
        some = some | n
    return some & hit


def value_findings(rows: DataFrame, value: Column, surface: str, keep: list[str], patterns: dict[str, str] = PATTERNS) -> DataFrame:
    """(keep, rule, severity): a row for each rule that a value breaks, in one pass over the values."""
    hit = F.array_compact(F.array(*(F.when(breaks(value, r, p), F.lit(r)) for r, p in patterns.items())))
    found = rows.select(*keep, F.explode(hit).alias("rule"))
    return found.withColumn("severity", severity(F.col("rule"), surface)).where("severity is not null")


class _Object(tuple):
    """The members of a JSON object in order, repeated keys included."""


class _Number(str):
    """A JSON number as it was written."""


def _kind(node) -> str:
    if isinstance(node, _Object):
        return "object"
    return {list: "array", str: "string", bool: "bool", type(None): "null"}.get(type(node), "number")


_NODE = "path array<struct<key:string,place:int>>, hint string, kind string, value string, populated boolean"


def json_nodes(rows: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, path, hint, kind, value, populated): every node of JSON texts, however deep.

    path has the keys and places on the way from the root (key null in an array), hint is
    the nearest key above, value the text of a scalar. Repeated keys all count, numbers stay
    as written. A text that is no JSON, or is nested too deep for the parser, is one node of
    kind 'text' with the whole text as its value; a null text gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = json.JSONDecoder(object_pairs_hook=_Object, parse_int=_Number, parse_float=_Number, parse_constant=_Number).decode
        types = [f.type for f in pa.schema([("path", pa.list_(pa.struct([("key", pa.string()), ("place", pa.int32())]))), ("hint", pa.string()), ("kind", pa.string()), ("value", pa.string()), ("populated", pa.bool_())])]
        for batch in batches:
            row, out = [], [[] for _ in types]
            for i, cell in enumerate(batch.column(1).to_pylist()):
                if cell is None:
                    continue
                try:
                    nodes = _walked(decode(cell))
                except (ValueError, RecursionError):
                    nodes = [((), None, "text", cell, cell.strip() != "")]
                for path, hint, kind, value, populated in nodes:
                    row.append(i)
                    for x, v in zip(out, ([{"key": k, "place": p} for k, p in path], hint, kind, value, populated)):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, t) for x, t in zip(out, types))], [ident, "path", "hint", "kind", "value", "populated"])

    kind = rows.schema[ident].dataType.simpleString()
    return rows.select(ident, text).mapInArrow(run, f"{ident} {kind}, {_NODE}")


def _walked(root) -> Iterator[tuple]:
    """(path, hint, kind, value, populated) of a node and of all below it, in order."""
    todo = [(root, (), None)]
    while todo:
        node, path, hint = todo.pop()
        kind = _kind(node)
        text = str(node).lower() if kind == "bool" else str(node) if kind in ("string", "number") else None
        yield path, hint, kind, text, len(node) > 0 if kind in ("object", "array") else kind != "null" and (kind != "string" or node.strip() != "")
        if kind == "object":
            todo += [(v, (*path, (k, i)), k) for i, (k, v) in reversed(list(enumerate(node)))]
        elif kind == "array":
            todo += [(v, (*path, (None, i)), hint) for i, v in reversed(list(enumerate(node)))]


def plain_pointer(path: Column) -> Column:
    """A JSON pointer with its keys as they are, '~' and '/' escaped."""
    step = lambda p: F.concat(F.lit("/"), F.coalesce(F.replace(F.replace(p["key"], F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")), p["place"].cast("string")))
    return F.array_join(F.transform(path, step), "")


def json_leaves(rows: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, pointer, value): the scalar leaves of JSON texts at any depth."""
    nodes = json_nodes(rows, ident, text).where("kind not in ('object', 'array')")
    return nodes.select(ident, plain_pointer(F.col("path")).alias("pointer"), "value")


def key_tokens(key: Column) -> Column:
    """The folded words of a key, cut at other signs and at camelCase borders."""
    words = F.split(fold_accents(F.regexp_replace(key, "(?<=[a-z0-9])(?=[A-Z])", " ")), "[^a-z0-9]+")
    return F.filter(words, lambda w: w != "")


def compact_key(key: Column) -> Column:
    return F.regexp_replace(fold_accents(key), "[^a-z0-9]", "")


def key_rule(key: Column) -> Column:
    """The rule that a key triggers by its name, null if none; the first that fits counts."""
    return let(F.struct(key_tokens(key).alias("words"), compact_key(key).alias("compact")), _rule_of_name)


def _rule_of_name(name: Column) -> Column:
    """The rule of a key (words, compact)."""
    words, compact = name["words"], name["compact"]
    some = lambda names: F.arrays_overlap(words, F.array(*map(F.lit, names)))
    spaced = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    phrase = lambda pairs: (F.size(words) > 1) & spaced.rlike(" (?:" + "|".join(" ".join(p) for p in pairs) + ") ")
    book = compact.isin(*T.BOOKKEEPING_KEYS) | compact.endswith("gatenote") | compact.rlike("^(?:" + "|".join(T.BOOKKEEPING_PREFIXES) + ")")
    return (
        F.when(compact == "winningpartynif", "POPULATED_WINNING_PARTY_NIF").when(some(T.CREDENTIAL_WORDS) | phrase(T.CREDENTIAL_PHRASES), "CREDENTIAL_KEY")
        .when(some(T.EMAIL_WORDS) | phrase(T.EMAIL_PHRASES), "EMAIL_KEY").when(some(T.CONTACT_WORDS), "CONTACT_KEY").when(some(T.PERSONAL_ID_WORDS), "PERSONAL_ID_KEY")
        .when(compact.isin(*T.RAW_KEYS) | phrase(T.RAW_PHRASES), "RAW_PAYLOAD_CARRIER").when(compact == "sourcefile", "FAMILY_SOURCE_FILE").when(book, "BOOKKEEPING_FIELD")
    )


def phone_like(value: Column) -> Column:
    """An international number, or a national one shortly after a word that announces it."""
    shapes = F.regexp_extract_all(value, F.lit(r"(?<![\w+])(\+\d[\d ().\-]{7,17}\d)(?!\w)"), 1)
    plus = value.contains("+") & F.exists(shapes, lambda m: F.length(F.regexp_replace(m, r"\D", "")).between(9, 15))
    labels = "|".join(rf"{w}(?![a-z0-9])[\s\S]{{0,{25 - len(w)}}}" for w in T.PHONE_LABELS)
    national = r"[6-9]\d{2}[ .\-]?\d{3}[ .\-]?\d{3}"
    return plus | value.rlike(national) & fold_accents(value).rlike(rf"(?<![a-z0-9])(?:{labels})(?<!\d){national}(?!\d)")


def personal_id_like(value: Column) -> Column:
    """A DNI or NIE with its right check letter, or any of that shape shortly after its name."""
    shapes = F.regexp_extract_all(value, F.lit(r"(?<![A-Za-z0-9/.\-])((?:\d{8}|[XYZxyz]\d{7})[A-Za-z])(?![A-Za-z0-9])"), 1)
    named = r"\b(?:dni|nie)\b[\s\S]{0,11}(?<![a-z0-9])(?:\d{8}|[xyz]\d{7})[a-z](?![a-z0-9])"
    return value.rlike(r"\d{7}") & (F.exists(shapes, tax_id_valid) | fold_accents(value).rlike(named))


def _authority(url: Column) -> tuple[Column, Column, Column]:
    """(user data, host, port) of scheme://authority, each '' if absent."""
    whole = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    user, rest = F.regexp_extract(whole, "^(.*)@", 1), F.regexp_replace(whole, "^.*@", "")
    port = F.regexp_extract(rest, r":([^:\]]*)$", 1)
    return user, F.regexp_replace(rest, r":[^:\]]*$", ""), port


def _bad_authority(url: Column) -> Column:
    user, host, port = _authority(url)
    port_ok = (port == "") | F.coalesce((port.rlike("^[0-9]+$")) & (port.try_cast("int") <= 65535), F.lit(False))
    labels = r"^(?:\[[0-9A-Fa-f:.]+\]|(?:[^\x00-\x7F]|[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?|\.(?=[^.]))+\.?)$"
    return (user != "") | (host == "") | ~port_ok | ~host.rlike(labels)


def unsafe_http(value: Column) -> Column:
    """Whether an http address anywhere in a text has user data, a bad port or no public host.

    Any run of slashes and backslashes after the colon counts as //, as browsers take it.
    """
    tokens = F.regexp_extract_all(value, F.lit(r"(?i)(?<!\w)(https?:\S+)"), 1)

    def bad(token: Column) -> Column:
        tail = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "^[A-Za-z]+:", ""), r"\\", "/"), "^/+", "")
        url = F.concat(F.lit("http://"), tail)
        return (tail == "") | _bad_authority(url) | private_host(_authority(url)[1])

    return value.rlike("(?i)https?:") & F.exists(tokens, bad)


def whole_public_url(value: Column) -> Column:
    """Whether a text is, as a whole, an http address without user data, white space or control signs."""
    return ~value.rlike(r"[\\\s\p{C}]") & value.rlike("^(?i:https?)://") & ~_bad_authority(value)


def dangerous_scheme(value: Column, url_like: Column) -> Column:
    """Whether a text names a scheme that is not for the web, or fills a URL field with no such address."""
    token = r"(?:^|(?<=[\s\"'(<,;]))([A-Za-z][A-Za-z0-9+.\-]{0,30}):"
    schemes = F.transform(F.regexp_extract_all(value, F.lit(token + r"(?=\S)"), 1), F.lower)
    opaque = F.transform(F.regexp_extract_all(value, F.lit(token + r"(?!//)(?=\S)"), 1), F.lower)
    listed = F.arrays_overlap(schemes, F.array(F.lit("data"), *map(F.lit, T.OPAQUE_SCHEMES)))
    bare = F.exists(opaque, lambda s: ~s.isin("http", "https"))
    return value.contains(":") & listed | url_like & (F.trim(value) != "") & (bare | ~whole_public_url(value))


def hard_rules(value: Column) -> list[tuple[str, Column]]:
    """The rules for private data and paths that keys and values share."""
    named = [(r, breaks(value, r, PATTERNS[r])) for r in ("PRIVATE_KEY_BLOCK", "CREDENTIAL_VALUE", "EMAIL_VALUE")]
    return [*named, ("CONTACT_VALUE", phone_like(value)), ("PERSONAL_ID_VALUE", personal_id_like(value)), *((r, breaks(value, r, PATTERNS[r])) for r in ("WINDOWS_ABS_PATH", "UNC_PATH", "UNIX_HOME_PATH"))]


def value_rules(value: Column, url_like: Column) -> list[tuple[str, Column]]:
    relative = r"(?:^|[\s\"'(/=])_tmp/|data/_backup/|(?:^|/)_backup"
    return [
        *hard_rules(value), ("DANGEROUS_URL_SCHEME", dangerous_scheme(value, url_like)), ("UNSAFE_URL_HOST", unsafe_http(value)),
        ("RELATIVE_TMP_PATH", value.rlike(relative)), ("LOCAL_MARKER", F.trim(value).isin("LOCAL", "LOCAL-ZIP")),
    ]


def _names(rules: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in rules)))


def safe_pointer(path: Column) -> Column:
    """The place of a node; a key that is sensitive, long or odd is named by its place only."""

    def step(p: Column) -> Column:
        key, rule = p["key"], key_rule(p["key"])
        hidden = ~key.rlike(r"^[A-Za-z0-9_.\-]{1,40}$") | F.coalesce(rule.isin("CREDENTIAL_KEY", "EMAIL_KEY", "CONTACT_KEY", "PERSONAL_ID_KEY"), F.lit(False)) | (F.size(_names(hard_rules(key))) > 0)
        return F.when(key.isNull(), F.concat(F.lit("["), p["place"].cast("string"), F.lit("]"))).when(hidden, F.concat(F.lit("/__redacted_key_"), p["place"].cast("string"), F.lit("__"))).otherwise(F.concat(F.lit("/"), key))

    return F.array_join(F.transform(path, step), "")


def tree_findings(rows: DataFrame, ident: str, text: str, surface: str, known: tuple[str, ...] = T.KNOWN_KEYS) -> DataFrame:
    """(ident, pointer, rule, severity, kind, length): every finding in JSON trees on a surface.

    Keys count by name, where that needs a value only if it has one, and as values; on the
    public build a key that no rule names and ``known`` does not list is SCHEMA_UNKNOWN.
    Rules that the surface suppresses give no row. A text that is no JSON is one value.
    """
    nodes = json_nodes(rows, ident, text)
    nodes = nodes.withColumn("key", F.when(F.size("path") > 0, F.try_element_at("path", F.lit(-1))["key"]))
    nodes = nodes.withColumns({"rule": key_rule(F.col("key")), "compact": compact_key(F.col("key"))})
    rule, compact = F.col("rule"), F.col("compact")
    gated = rule.isin("CREDENTIAL_KEY", "EMAIL_KEY", "CONTACT_KEY", "PERSONAL_ID_KEY", "POPULATED_WINNING_PARTY_NIF", "RAW_PAYLOAD_CARRIER")
    unknown = F.when(F.lit(surface == "public-build") & rule.isNull() & (compact != "") & ~compact.isin(*known), "SCHEMA_UNKNOWN")
    by_name = F.array_compact(F.array(F.when(gated & ~F.col("populated"), None).otherwise(F.coalesce(rule, unknown))))
    as_value = _names([*hard_rules(F.col("key")), ("DANGEROUS_URL_SCHEME", dangerous_scheme(F.col("key"), F.lit(False))), ("UNSAFE_URL_HOST", unsafe_http(F.col("key")))])
    from_key = F.when(F.col("key").isNotNull(), F.concat(by_name, as_value)).otherwise(F.array().cast("array<string>"))
    url_like = F.coalesce(F.arrays_overlap(key_tokens(F.col("hint")), F.array(*map(F.lit, ("url", "uri", "href", "link")))), F.lit(False))
    is_text = F.col("kind").isin("string", "text") & (F.col("value") != "")
    from_value = F.when(is_text, _names(value_rules(F.col("value"), url_like))).otherwise(F.array().cast("array<string>"))
    found = nodes.select(ident, "path", "kind", F.length("value").alias("length"), F.explode(F.concat(from_key, from_value)).alias("rule"))
    found = found.withColumn("severity", severity(F.col("rule"), surface)).where("severity is not null")
    return found.select(ident, safe_pointer(F.col("path")).alias("pointer"), "rule", "severity", "kind", "length")


def finding_order() -> list[Column]:
    """Errors before warnings, then by rule and place."""
    return [F.when(F.col("severity") == "ERROR", 0).otherwise(1).asc(), F.col("rule").asc(), F.col("pointer").asc()]


def outcome(findings: DataFrame, rows: DataFrame, ident: str) -> DataFrame:
    """(ident, errors, warnings, outcome): FAIL with an error, WARN with warnings only, else PASS."""
    counts = findings.groupBy(ident).agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARN").alias("warnings"))
    out = rows.select(ident).distinct().join(counts, ident, "left").fillna(0, ["errors", "warnings"])
    return out.withColumn("outcome", F.when(F.col("errors") > 0, "FAIL").when(F.col("warnings") > 0, "WARN").otherwise("PASS"))


def summary(findings: DataFrame) -> DataFrame:
    """(severity, rule, n)."""
    return findings.groupBy("severity", "rule").agg(F.count("*").alias("n"))


def collapsed(findings: DataFrame, keys: tuple[str, ...] = ("source", "surface", "severity", "rule", "pointer", "kind", "length")) -> DataFrame:
    """Each finding once with ``n``, how often it occurs."""
    return findings.groupBy(*keys).agg(F.count("*").alias("n"))


def report_order() -> list[Column]:
    """By source and surface, errors before warnings, then by rule and place."""
    return [F.col("source").asc(), F.col("surface").asc(), *finding_order()]


def grouped_summary(findings: DataFrame) -> DataFrame:
    """(severity, rule, source, n): bounded by rules and sources, whatever the number of findings."""
    return findings.groupBy("severity", "rule", "source").agg(F.count("*").alias("n"))
