"""Grouped measures: profiles, coverage, composition, rankings, set comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.notices import budget_bucket
from ..functions.semantics import pct, upper_median


def profile(df: DataFrame, keys: Sequence[str], status: Column, amount: Column) -> DataFrame:
    """Status split and amount distribution of each group (all rows for no keys)."""
    df, known = df.withColumn("_known", F.when(amount > 0, amount)), F.col("_known")
    one = lambda s: F.count_if(status == s)
    out = df.groupBy(*keys).agg(
        F.count("*").alias("total"), one("Vigente").alias("open"), one("Adjudicado").alias("awarded"), one("Desierta").alias("void"),
        F.count(known).alias("with_amount"), upper_median("_known").alias("median_amount"), F.min(known).alias("min_amount"), F.max(known).alias("max_amount"),
        F.round(F.sum(known), 2).alias("sum_amount"),
    )
    return out.withColumn("other", F.col("total") - F.col("open") - F.col("awarded") - F.col("void"))


def bucket_counts(df: DataFrame, keys: Sequence[str], amount: Column) -> DataFrame:
    return df.groupBy(*keys, budget_bucket(amount).alias("bucket")).agg(F.count("*").alias("n"))


def coverage(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field, n, pct): how many rows have each field, as rows of one scan."""
    counts = df.agg(F.count("*").alias("total"), *(F.count_if(p).alias(f"c{i}") for i, p in enumerate(fields.values())))
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"c{i}").alias("n")) for i, f in enumerate(fields)))
    flat = counts.select("total", F.explode(pairs).alias("p"))
    return flat.select("p.field", "p.n", pct(F.col("p.n"), F.col("total")).alias("pct"))


def exploded_counts(df: DataFrame, values: Column, none: str = "__none__") -> DataFrame:
    """(value, n) over the elements of an array column; rows without any count under ``none``."""
    flat = df.select(F.explode(F.when(F.size(values) > 0, values).otherwise(F.array(F.lit(none)))).alias("value"))
    return flat.groupBy("value").agg(F.count("*").alias("n"))


def most_common(df: DataFrame, value: Column, position: Column, k: int) -> DataFrame:
    """(value, n): the k most frequent values, ties by first appearance."""
    counts = df.groupBy(value.alias("value")).agg(F.count("*").alias("n"), F.min(position).alias("_first"))
    return counts.orderBy(F.desc("n"), "_first", "value").limit(k).drop("_first")


def nested_counts(df: DataFrame, key: Column, inner: Column, amount: Column) -> DataFrame:
    """(key, n, amount_n, amount_sum, by): groups with a sorted list of counts by the inner value."""
    fine = df.groupBy(key.alias("key"), inner.alias("inner")).agg(F.count("*").alias("n"), F.count_if(amount > 0).alias("an"), F.sum(F.when(amount > 0, amount)).alias("as"))
    by = F.array_sort(F.collect_list(F.when(F.col("inner").isNotNull(), F.struct("inner", "n"))))
    return fine.groupBy("key").agg(F.sum("n").alias("n"), F.sum("an").alias("amount_n"), F.round(F.sum("as"), 2).alias("amount_sum"), by.alias("by"))


def ranked_inside(df: DataFrame, outer: Column, inner: Column, k: int) -> DataFrame:
    """(outer, inner, n, rank): the k most frequent inner values of each outer one, ties by value."""
    counts = df.groupBy(outer.alias("outer"), inner.alias("inner")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("outer").orderBy(F.desc("n"), "inner"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def composition(df: DataFrame, label: Column) -> DataFrame:
    """(label, n, share, start): shares of all rows, largest first, each starting where the last ended.

    The windows run over one row for each label.
    """
    counts = df.groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("n"), "label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select("label", "n", F.round(F.col("n") / total, 6).alias("share"), F.round(before / total, 6).alias("start"))


def identity_count(df: DataFrame, ident: Column, url: Column, position: Column) -> DataFrame:
    """Distinct identities: by id, else by url, else each row for itself."""
    kind = F.when(F.coalesce(ident != "", F.lit(False)), "id").when(F.coalesce(url != "", F.lit(False)), "url").otherwise("row")
    value = F.when(kind == "id", ident).when(kind == "url", url).otherwise(position.cast("string"))
    return df.select(kind.alias("kind"), value.alias("value")).distinct().agg(F.count("*").alias("identities"), F.count_if(F.col("kind") == "id").alias("by_id"), F.count_if(F.col("kind") == "url").alias("by_url"))


def multiset_difference(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(value, in_a, in_b) where two tables hold a value different times; empty if they agree."""
    tagged = a.select(F.col(column).alias("value"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(F.col(column).alias("value"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    return tagged.groupBy("value").agg(F.sum("a").alias("in_a"), F.sum("b").alias("in_b")).where("in_a <> in_b")


def set_change(before: Column, after: Column) -> Column:
    """How a reclassification changes a row's set of labels."""
    gained, lost = F.array_except(after, before), F.array_except(before, after)
    return (
        F.when((F.size(gained) == 0) & (F.size(lost) == 0), F.when(F.size(after) == 0, "still_none").otherwise("unchanged"))
        .when(F.size(before) == 0, "newly").when(F.size(lost) == 0, "gained").when(F.size(gained) == 0, "lost").otherwise("changed")
    )


def reclassified(rows: DataFrame, ident: str, existing: Column, proposed: Column, matched: Column, known: Sequence[str]) -> DataFrame:
    """rows' (ident, before, after, added, matched): the sorted union of existing and proposed labels; one with an unknown label leaves the existing ones."""
    none = F.array().cast("array<string>")
    before = F.array_sort(F.array_distinct(F.coalesce(existing, none)))
    union = F.array_sort(F.array_union(before, F.coalesce(proposed, none)))
    after = F.when(F.exists(union, lambda d: ~d.isin(*known)), before).otherwise(union)
    out = rows.select(ident, before.alias("before"), after.alias("after"), F.coalesce(matched, none).alias("matched"))
    return out.withColumn("added", F.array_except("after", "before"))


def reclassification_report(changes: DataFrame, known: Sequence[str]) -> DataFrame:
    """(measure, value, before, after, n) of reclassified rows, from one aggregation.

    For each label its rows before and after; for each keyword its hits (n); and as counts
    (value null): rows, records_changed, additions, newly_classified, unclassified before and
    after, unknown labels among the existing ones.
    """
    pair = lambda m, v=F.lit(None).cast("string"), b=F.lit(0), a=F.lit(0), n=F.lit(0): F.struct(F.lit(m).alias("measure"), v.alias("value"), b.cast("long").alias("before"), a.cast("long").alias("after"), n.cast("long").alias("n"))
    one, changed = F.lit(1), F.size("added") > 0
    bare = lambda c: F.when(F.size(c) == 0, 1).otherwise(0)
    counts = F.array(
        pair("records", n=one), pair("records_changed", n=changed.cast("int")), pair("additions", n=F.size("added")), pair("newly_classified", n=(changed & (F.size("before") == 0)).cast("int")), pair("unclassified", b=bare("before"), a=bare("after")),
        pair("unknown_labels", n=F.size(F.filter("before", lambda d: ~d.isin(*known)))),
    )
    labels = F.concat(F.transform("before", lambda d: pair("label", d, b=F.lit(1))), F.transform("after", lambda d: pair("label", d, a=F.lit(1))), F.transform("matched", lambda k: pair("keyword", k, n=F.lit(1))))
    flat = changes.select(F.explode(F.concat(counts, labels)).alias("p")).select("p.*")
    return flat.groupBy("measure", "value").agg(F.sum("before").alias("before"), F.sum("after").alias("after"), F.sum("n").alias("n"))


def script_identities(records: DataFrame, text: str, position: str) -> DataFrame:
    """(identities, unsupported): how many keys a script's map would have over JSON records, by id, else by url, else by place.

    Numbers are one namespace (1 is 1.0), booleans and texts others; '', 0, false and null count
    as missing; the key of a place is a text, which a record's own id may equal. A list or an
    object as a key, or a record that is no object, is unsupported and must stop a caller.
    """
    whole = F.try_parse_json(F.col(text))
    get = lambda p: F.try_variant_get(whole, p, "variant")
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))

    def key(path: str) -> Column:
        k, as_ = kind(get(path)), (lambda t: F.try_variant_get(whole, path, t))
        number = ~k.rlike("^(STRING|BOOLEAN|VOID|ARRAY|OBJECT)")
        return (
            F.when(k.rlike("^(ARRAY|OBJECT)"), "unsupported").when(k == "STRING", F.when(as_("string") != "", F.concat(F.lit("str:"), as_("string")))).when(k == "BOOLEAN", F.when(as_("boolean"), "bool:true"))
            .when(number, F.when(as_("double") != 0, F.concat(F.lit("num:"), as_("double").cast("string"))))
        )

    place = F.concat(F.lit("str:__idx__"), F.col(position).cast("string"))
    found = F.when(kind(whole).startswith("OBJECT"), F.coalesce(key("$.id"), key("$.url"), place)).otherwise("unsupported")
    keys = records.select(found.alias("key")).groupBy("key").count()
    return keys.agg(F.count_if(F.col("key") != "unsupported").alias("identities"), F.coalesce(F.sum(F.when(F.col("key") == "unsupported", F.col("count"))), F.lit(0)).alias("unsupported"))


def medians(df: DataFrame, keys: Sequence[str], value: Column, cells: int = 256) -> DataFrame:
    """(keys, median): the exact upper median of each group, the value at floor(n / 2) from 0; groups without values have no row.

    For groups of very many different values, which upper_median would hold in one counter
    each: equal values are counted first, the cell (``cells`` for each doubling) that holds
    the median is found from the cells' counts, and only that cell's values are put in order,
    by a sort that can spill.
    """
    counts = df.select(*keys, value.cast("double").alias("_v")).where("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_cell", F.signum("_v") * F.floor(F.log2(F.abs("_v") + 1) * cells))
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_n").over(own.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_cell = counts.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_n")).withColumns({"_before": before, "_at": F.floor(F.sum("_n").over(own) / 2)})
    hit = by_cell.where((F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_n"))).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_cell").alias("_c"), (F.col("_at") - F.col("_before")).alias("_at"))
    same = F.col("_cell") == F.col("_c")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    upto = F.sum("_n").over(own.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    rows = counts.join(hit, same).withColumn("_upto", upto)
    return rows.where((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_n") <= F.col("_at"))).select(*keys, F.col("_v").alias("median"))
