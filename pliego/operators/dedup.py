"""Choosing among rows: best of a group, first seen, accepted only, ranked, capped.

Best-of-group is an aggregation (max_by), which combines before the shuffle and never
sorts or holds a group; windows are used only where each row needs its own answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_of(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column]) -> DataFrame:
    """One row of each group: that with the greatest ``order``, compared from left to right.

    Nulls are least. End ``order`` with a unique column for a defined result; negate a
    number to prefer the smaller one.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    rank = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    best = df.groupBy(*(k.alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.max_by(F.struct(*df.columns), rank).alias("_best"))
    return best.select("_best.*")


def accepted_only_duplicates(df: DataFrame, key: Sequence[str], position: str, accepted: Column) -> Column:
    """Whether an earlier accepted row has the row's key. Rejected rows suppress nothing."""
    first = F.min(F.when(accepted, F.col(position))).over(Window.partitionBy(*key))
    return F.coalesce(F.col(position) > first, F.lit(False))


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group; ranks beyond n are dropped before the sort's shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def first_accepted(df: DataFrame, keys: Sequence[str], position: str, label: str) -> DataFrame:
    """df with ``first`` (whether the row is the first of its key) and ``first_label`` of that row."""
    firsts = df.groupBy(*keys).agg(F.min(F.struct(position, label)).alias("_f"))
    return df.join(firsts, list(keys)).withColumn("first", F.col(position) == F.col(f"_f.{position}")).withColumn("first_label", F.col(f"_f.{label}")).drop("_f")


def prefer(df: DataFrame, keys: Sequence[str], preferred: Column) -> DataFrame:
    """Rows of groups with a preferred row keep only the preferred ones."""
    has = F.max(preferred.cast("int")).over(Window.partitionBy(*keys))
    return df.withColumn("_has", has).where((F.col("_has") == 0) | preferred).drop("_has")


def round_robin(df: DataFrame, group: Sequence[str], order: Sequence[Column], tier: Sequence[Column] = ()) -> DataFrame:
    """df with ``turn``: the row's number in its group, and ``group_first``: where its group begins.

    Ordered by (tier, turn, group_first), groups take turns.
    """
    own = Window.partitionBy(*group).orderBy(*order)
    lead = F.struct(*(c.alias(f"g{i}") for i, c in enumerate(order_values(order))))
    return df.withColumn("turn", F.row_number().over(own)).withColumn("group_first", F.min(lead).over(Window.partitionBy(*group)))


def order_values(order: Sequence[Column]) -> Sequence[Column]:
    return order


def within_budget(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cost: Column, budget: float) -> DataFrame:
    """Rows of each group in order until their running cost passes the budget."""
    spent = F.sum(cost).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_spent", spent).where(F.col("_spent") <= budget).drop("_spent")


def error_streaks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], error: Column) -> DataFrame:
    """df with ``streak``: consecutive errors up to and including the row, 0 on a good row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    island = F.sum(F.when(error, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_island", island)
    run = F.sum(F.when(error, 1).otherwise(0)).over(Window.partitionBy(*keys, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("streak", run).drop("_island")


def stratified(df: DataFrame, stratum: str, order: Sequence[Column], each: int = 1) -> DataFrame:
    """The first rows of each stratum."""
    return top_n(df, [stratum], order, each)


def spread(df: DataFrame, stratum: str, strata: Sequence[str], position: str, n: int = 5) -> DataFrame:
    """n rows: the first one of each stratum, in the order of ``strata``, then others by position. Each stratum needs its first n rows at most."""
    few = top_n(df, [stratum], [F.col(position)], n)
    first = F.row_number().over(Window.partitionBy(stratum).orderBy(position)) == 1
    at = F.array_position(F.array(*map(F.lit, strata)), F.col(stratum))
    ranked = few.withColumn("_first", F.when(first & (at > 0), at))
    return ranked.orderBy(F.col("_first").asc_nulls_last(), F.col(position)).limit(n).drop("_first")
