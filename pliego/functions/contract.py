"""The public contract: timestamps, generation identities, hosts, order-free digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZULU = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
GENERATION = r"^gen-(\d{8}T\d{6}Z)-([0-9a-f]{12})$"


def to_zulu(value: Column) -> Column:
    """A timestamp text as UTC with seconds, null if it is none; a text without a zone is UTC."""
    return F.date_format(F.try_to_timestamp(F.trim(value)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def is_zulu(value: Column) -> Column:
    return F.coalesce(value.rlike(ZULU), F.lit(False))


def in_order(*values: Column) -> Column:
    """Whether all are UTC texts, none before the one ahead of it."""
    out = is_zulu(values[0])
    for a, b in zip(values, values[1:]):
        out = out & is_zulu(b) & F.coalesce(a <= b, F.lit(False))
    return out


def generation_matches(ident: Column, generated: Column, digest: Column) -> Column:
    """Whether a generation id is that of its timestamp and digest."""
    stamp = F.regexp_replace(F.coalesce(generated, F.lit("")), "[-:]", "")
    return F.coalesce(ident.rlike(GENERATION) & (F.regexp_extract(ident, GENERATION, 1) == stamp) & (F.regexp_extract(ident, GENERATION, 2) == F.left(digest, F.lit(12))), F.lit(False))


def private_host(host: Column) -> Column:
    """Whether a host is local, in a private network, or an address in disguise."""
    h = F.lower(F.regexp_replace(F.coalesce(host, F.lit("")), r"\.$", ""))
    named = h.isin("", "localhost", "metadata.google.internal") | h.rlike(r"\.(local|localhost|internal|lan|home|corp)$")
    networks = r"^(0|10|127)\.|^169\.254\.|^192\.168\.|^172\.(1[6-9]|2\d|3[01])\.|^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^(22[4-9]|2[3-5]\d)\."
    disguised = h.rlike(r"^(0x[0-9a-f]+|\d+)$") | h.rlike(r"^(0x[0-9a-f]+|0\d+)(\.|$)")
    six = h.rlike(r"^\[?(::1?|fe80:|f[cd][0-9a-f]{2}:)")
    return named | h.rlike(networks) | disguised | six


def public_url(url: Column) -> Column:
    """Whether a URL is http or https to a public host, without user data."""
    scheme, host, user = (F.try_parse_url(F.trim(url), F.lit(p)) for p in ("PROTOCOL", "HOST", "USERINFO"))
    return F.coalesce(F.lower(scheme).isin("http", "https") & ~private_host(host) & user.isNull(), F.lit(False))


def digest(df: DataFrame) -> DataFrame:
    """(records, digest): a digest of the rows as JSON that does not depend on their order.

    It is made of sums of row hashes, so it needs no sort and no driver.
    """
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    return df.agg(F.count("*").alias("records"), F.sha2(F.concat_ws(":", *(F.coalesce(p, F.lit(0).cast("decimal(38,0)")).cast("string") for p in parts)), 256).alias("digest"))
