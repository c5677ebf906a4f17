"""Four-month periods: measures, comparison with the period before, trailing series, signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import js_round, pct, period_index, third, upper_median


def period_metrics(df: DataFrame, date: Column, amount: Column, status: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, year, third, idx, measures): all periods with rows, in one aggregation."""
    rows = df.withColumns({"_y": F.year(date), "_t": third(date), "_known": F.when(amount > 0, amount)}).where("_t > 0")
    known = F.col("_known")
    out = rows.groupBy(*keys, F.col("_y").alias("year"), F.col("_t").alias("third")).agg(
        F.count("*").alias("total"), F.count(known).alias("with_amount"), upper_median("_known").alias("median_amount"), F.round(F.sum(known), 2).alias("sum_amount"),
        F.count_if(status == "Vigente").alias("open"), F.count_if(status == "Adjudicado").alias("awarded"), F.count_if(status == "Desierta").alias("void"),
    )
    return out.withColumn("idx", period_index(F.col("year"), F.col("third")))


def with_previous(metrics: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """metrics with ``previous_total``: the total of the calendar period before, 0 if it has no rows."""
    before = metrics.select(*keys, (F.col("idx") + 1).alias("idx"), F.col("total").alias("previous_total"))
    out = metrics.join(before, [*keys, "idx"], "left").fillna(0, ["previous_total"])
    delta = F.col("total") - F.col("previous_total")
    return out.withColumn("delta", delta).withColumn("delta_pct", F.when(F.col("previous_total") > 0, js_round(delta / F.col("previous_total") * 100)).otherwise(0).cast("long"))


def trailing(metrics: DataFrame, n: int = 6) -> DataFrame:
    """(idx, offset, total): the n periods up to the last one, those without rows as 0."""
    last = metrics.agg(F.max("idx").alias("last"))
    spine = last.select(F.explode(F.sequence(F.col("last") - (n - 1), F.col("last"))).alias("idx"))
    return spine.join(metrics.groupBy("idx").agg(F.sum("total").alias("total")), "idx", "left").fillna(0, ["total"])


def latest(metrics: DataFrame) -> DataFrame:
    """(year, third) of the last period that has rows."""
    return metrics.agg(F.max(F.struct("year", "third")).alias("p")).select("p.*")


def signals(metrics: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, year, third, signal): rule-based signals of each period against the one before.

    Periods are compared only if the one before has rows and this one has ten or more.
    """
    w = Window.partitionBy(*keys).orderBy("idx")
    p = F.lag(F.struct("idx", "total", "with_amount", "void")).over(w)
    rows = metrics.withColumn("p", F.when(p["idx"] == F.col("idx") - 1, p))
    comparable = F.col("p").isNotNull() & (F.col("total") >= 10)
    void_now, void_before = pct(F.col("void"), F.col("total")), pct(F.col("p.void"), F.col("p.total"))
    found = F.array_compact(
        F.array(
            F.when(comparable & (F.col("total") > F.col("p.total")), "more_activity").when(comparable & (F.col("total") < F.col("p.total")), "less_activity"),
            F.when(comparable & (F.col("with_amount") > F.col("p.with_amount")), "more_amounts").when(comparable & (F.col("with_amount") < F.col("p.with_amount")), "fewer_amounts"),
            F.when(comparable & (F.col("void") >= 3) & (void_now > void_before), "more_void"),
            F.when(F.col("total") < 10, "low_volume"),
            F.when(F.col("p").isNull(), "no_previous"),
        )
    )
    return rows.select(*keys, "year", "third", F.explode(found).alias("signal"))
