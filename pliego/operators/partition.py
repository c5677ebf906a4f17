"""Year shards with priorities, their manifest, identities and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import truthy


def year_of(*dates: Column) -> Column:
    """The year of the first date text that is not blank, null if it has none."""
    first = F.coalesce(*(truthy(d) for d in dates))
    return F.nullif(F.regexp_extract(first, r"^(\d{4})", 1), F.lit("")).cast("int")


def shard_of(year: Column, years: tuple[int, ...]) -> Column:
    return F.when(year.isin(*years), year.cast("string")).otherwise("archive")


def priority(shard: Column, years: tuple[int, ...]) -> Column:
    """1 for the two latest years, 2 for the other listed ones, 3 for the archive."""
    latest = [str(y) for y in sorted(years)[-2:]]
    return F.when(shard.isin(*latest), 1).when(shard == "archive", 3).otherwise(2)


def manifest(rows: DataFrame, shard: str, years: tuple[int, ...], ident: str) -> DataFrame:
    """(shard, priority, records, digest): the digest does not depend on the order of rows."""
    out = rows.groupBy(shard).agg(F.count("*").alias("records"), F.bit_xor(F.xxhash64(ident)).alias("digest"))
    return out.withColumn("priority", priority(F.col(shard), years))


def write_shards(rows: DataFrame, shard: str, path: str, form: str = "parquet") -> None:
    """One folder for each shard; a reader that asks for some shards opens only those."""
    rows.write.mode("overwrite").partitionBy(shard).format(form).save(path)


def candidate_id(*parts: Column) -> Column:
    return F.left(F.sha1(F.concat_ws("|", *parts)), F.lit(16))


def generation_id(timestamp: Column, digest: Column) -> Column:
    return F.concat(F.lit("gen-"), F.regexp_replace(timestamp, r"[^0-9TZ]", ""), F.lit("-"), F.left(digest, F.lit(12)))
