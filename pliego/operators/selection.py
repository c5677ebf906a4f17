"""A bounded pilot: records in an order in which groups take turns, cut by caps on records and documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_turns(records: DataFrame, tier: str, group: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """The first ``most`` records in turn order, with ``place`` from 0.

    Tiers follow each other. In a tier the first records (by ``order``) of all groups come
    first, then the second ones; groups go by their first records. A record's own group
    has turn - 1 records before it, so later turns than ``most`` can't be taken: Spark drops them
    before the sort, however large a group is, and the last sort is a top-k of ``most`` rows.
    """
    key = F.struct(*order)
    own = Window.partitionBy(tier, *group).orderBy(*(F.col(c).asc_nulls_first() for c in order))
    turns = records.withColumn("turn", F.row_number().over(own)).withColumn("_first", F.first(key).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    by = [F.col(tier), F.col("turn"), F.col("_first"), key.asc()]
    chosen = turns.where(F.col("turn") <= most).orderBy(*by).limit(most)
    return chosen.withColumn("place", F.row_number().over(Window.orderBy(*by)) - 1).drop("_first")  # most rows at most


def capped(records: DataFrame, place: str, size: Column, most_records: int, most_items: int, most_each: int) -> DataFrame:
    """Records in order of place with ``taken``, how many of their items are taken: up to ``most_each``, until either cap is reached; the last record may lose some.

    Records without items are passed over and use up no cap. The running sum is over the rows given, which a caller bounds (see ``in_turns``).
    """
    rows = records.withColumn("_size", F.least(size.cast("long"), F.lit(most_each))).where("_size > 0")
    before = Window.orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).withColumn("_rank", F.row_number().over(Window.orderBy(place)))
    rows = rows.where((F.col("_rank") <= most_records) & (F.col("_before") < most_items))
    return rows.withColumn("taken", F.least("_size", F.lit(most_items) - F.col("_before"))).drop("_size", "_before", "_rank")


def pilot(records: DataFrame, documents: str, deadline_valid: Column, most_records: int, most_documents: int, each: int) -> DataFrame:
    """records (id, organisme, ccaa, documents: the eligible ones) chosen for a pilot, with place, selection_tier and the documents taken.

    Records whose deadline is open come first, those with fewer documents before others, bodies
    and territories in turn. Every record takes a document at least, so no more records than
    either cap are ever looked at.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    n = F.coalesce(F.size(documents), F.lit(0))
    rows = records.where(n > 0).withColumns({"_n": n, "_org": text("organisme"), "_place": text("ccaa"), "_id": text("id"), "_tier": F.when(F.coalesce(deadline_valid, F.lit(False)), 1).otherwise(2)})
    turns = in_turns(rows, "_tier", ["_org", "_place"], ["_n", "_org", "_place", "_id"], min(most_records, most_documents))
    chosen = capped(turns, "place", F.col("_n"), most_records, most_documents, each)
    tier = F.when(F.col("_tier") == 1, "deadline_valid").otherwise("strict_temporal_fallback")
    return chosen.select("place", "id", tier.alias("selection_tier"), F.slice(documents, F.lit(1), F.col("taken").cast("int")).alias(documents), *(c for c in records.columns if c not in ("id", documents)))
