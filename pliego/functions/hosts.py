"""Host names in any script: one canonical form for all spellings, what it stands for, and texts without marks.

Plain ASCII is judged by built-in expressions. Only what they cannot say goes to Python, in
Arrow batches: other scripts (international labels coded in ASCII, Unicode decomposed), and
addresses of numbers.
"""

from __future__ import annotations

import ipaddress
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from .semantics import fold_accents

_KIND = StructType([StructField("kind", StringType()), StructField("value", StringType()), StructField("private", BooleanType())])
_LABELS = r"^([A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)(\.[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*$"
_NUMBERS = r"(?i)^(0x[0-9a-f]+|[0-9]+)(\.(0x[0-9a-f]+|[0-9]+))*$"


def _address(text: str) -> tuple[str, str, bool] | None:
    try:
        ip = ipaddress.ip_address(text)
    except ValueError:
        return None
    return "ip", str(ip), ip.is_loopback or ip.is_private or ip.is_link_local or ip.is_unspecified or ip.is_reserved or ip.is_multicast


def _odd_host(host: str) -> tuple[str, str | None, bool]:
    """ip with its canonical form, dns with the ASCII form of a name in another script, or invalid."""
    found = _address(host)
    if found is None:
        try:
            host = host.encode("idna").decode("ascii").lower()
        except UnicodeError:
            return "invalid", None, True
        found = _address(host)  # signs that stand for digits and dots are plain now
    return found or ("dns", host, False)


@F.pandas_udf(_KIND)
def _odd_hosts(hosts: pd.Series) -> pd.DataFrame:
    rows = [(None, None, None) if h is None else _odd_host(h) for h in hosts]
    return pd.DataFrame(rows, columns=["kind", "value", "private"])


def canonical_host(host: Column) -> Column:
    """struct(kind, value): ip, dns or invalid, with the one spelling that all others stand for.

    Names are lower case ASCII without a closing dot. A host of numbers only that is no plain
    address (one number, octal or hexadecimal parts, too few) is invalid: browsers read
    an address from it. Null, empty and malformed hosts are invalid.
    """
    plain = host.rlike(r"^[\x21-\x7e]+$") & ~F.contains(host, F.lit(":")) & ~host.rlike(r"^[0-9.]+$")
    odd = _odd_hosts(F.when(~plain & (host != ""), host))
    kind, value = F.when(plain, "dns").otherwise(odd["kind"]), F.when(plain, F.lower(host)).otherwise(odd["value"])
    name = F.when(F.endswith(value, F.lit(".")) & (F.length(value) > 1), F.left(value, F.length(value) - 1)).otherwise(value)
    fine = (F.length(name) <= 253) & name.rlike(_LABELS) & ~name.rlike(_NUMBERS)
    found = F.when(kind == "ip", "ip").when(F.coalesce((kind == "dns") & fine, F.lit(False)), "dns").otherwise("invalid")
    return F.struct(found.alias("kind"), F.when(found == "ip", value).when(found == "dns", name).alias("value"))


def unsafe_host(host: Column) -> Column:
    """Whether a host must not be reached from outside: private, local, reserved or no host at all. An empty one is no host to judge."""
    bare = F.regexp_replace(F.coalesce(host, F.lit("")), r"^\[|\]$", "")
    found = canonical_host(bare)
    private = _odd_hosts(F.when(found["kind"] == "ip", found["value"]))["private"]
    local = found["value"].rlike(r"(^|\.)localhost$|\.local$|\.internal$")
    return F.when(bare == "", False).when(found["kind"] == "invalid", True).when(found["kind"] == "dns", local).otherwise(private)


def whole_public_url(url: Column) -> Column:
    """Whether a text is, from its first to its last sign, an http or https URL with a host and a port that can be, and no user data."""
    parts = r"^(?i:https?)://([^/?#]*)"
    authority = F.regexp_extract(url, parts, 1)
    host = F.regexp_replace(F.regexp_replace(authority, r":[0-9]*$", ""), r"^\[|\]$", "")
    port = F.regexp_extract(authority, r":([0-9]*)$", 1)
    clean = ~url.rlike(r"[\\\s\p{C}\p{Z}]") & url.rlike(parts) & ~F.contains(authority, F.lit("@"))
    port_fits = (port == "") | (port.try_cast("int") <= 65535)
    return F.coalesce(clean & port_fits & (host != "") & (canonical_host(host)["kind"] != "invalid"), F.lit(False))


@F.pandas_udf(StringType())
def _decomposed(texts: pd.Series) -> pd.Series:
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
    return texts.map(lambda t: None if t is None else plain(t))


def fold_marks(c: Column, collapse: bool = False) -> Column:
    """Lower case without marks by Unicode decomposition, so ligatures and width forms open up; ``collapse`` joins white space and trims.

    Texts that the table of Latin letters makes ASCII never leave the JVM.
    """
    quick = fold_accents(c)
    rest = quick.rlike(r"[^\x00-\x7f]")
    out = F.when(rest, _decomposed(F.when(rest, c))).otherwise(quick)
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " ")) if collapse else out
