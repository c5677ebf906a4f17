"""Operator 6: mixing sources to target weights by systematic sampling.

DataFrame functions only. Each document of a source expects target / source size copies.
Documents of a source are ordered by size class and then by a hash, their expected copies
are summed in that order from one random offset of the source, and a document is emitted
once for each integer boundary its interval crosses. As sizes rise along the order, the
words taken follow the target closely.

No task gets a whole source: positions come from the counts of a source's size classes (some
hundreds), of the 4096 hash buckets in a class, and from ranks inside one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import WORD, bounded, whole_row, written

#: A source is taken this many times at most.
MOST = 3
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)


def _source_key(source: Column) -> Column:
    """A key without nulls that tells a null source from all others."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(key, source_size, target, rate, offset), one row for each source of (key, size).

    The sources share all words by weight; a target stops at ``most`` times its source's
    size and the excess is shared by weight among the others, until none is above. This is
    the level at which the weighted shares, capped, use up all words: with the sources
    ordered by cap / weight, those before the first that stays below its cap are capped.

    The ranks and sums over sources are taken in one task, which gets one row for each
    source: the number of sources must be one that a task can sort.
    """
    totals = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    by_name = Window.orderBy((F.col("key") == "n"), "key")  # key order is code point order; null last
    cycle = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = totals.withColumn("weight", cycle).withColumn("cap", F.col("source_size") * most)
    filled = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "key").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(filled), F.lit(0))
    heft = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0))
    rows = rows.withColumn("level", left / heft)
    below = F.col("level") * F.col("weight") <= F.col("cap")
    rows = rows.withColumn("level", F.max(F.when(below, F.col("level"))).over(everything))
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit("offset:"), F.col("key"))), 1, 5), 16, 10).cast("double") / (1 << 20)
    return rows.select("key", "source_size", target.alias("target"), F.coalesce(F.try_divide(target, F.col("source_size")), F.lit(0.0)).alias("rate"), offset.alias("offset"))


def _placed(rows: DataFrame) -> DataFrame:
    """rows (key, size, hash, ...) with place, the position from 0 in the order of their source."""
    bits = F.length(F.bin("size"))
    cell = {
        "class": (bits * 16 + F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0))")).cast("int"),
        "bucket": F.substring("hash", 1, 3),
    }
    rows = rows.withColumns(cell)
    counts = rows.groupBy("key", "class", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("key").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = counts.groupBy("key", "class").agg(F.sum("n").alias("n")).select("key", "class", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("class_first"))
    before = Window.partitionBy("key", "class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("key", "class", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("cell_first"))
    starts = starts.join(classes, ["key", "class"]).select("key", "class", "bucket", (F.col("class_first") + F.col("cell_first")).alias("first"))
    inside = Window.partitionBy("key", "class", "bucket").orderBy("hash", "id", "size")
    return rows.join(starts, ["key", "class", "bucket"]).withColumn("place", F.col("first") + F.row_number().over(inside) - 1)


def mixed(docs: DataFrame, columns: list[str] | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(row, size, source_size, target, copies), one row for each row of docs.

    ``row`` is a struct of the given columns of docs (all by default), so their names cannot
    clash. size is the number of words of the text, 0 for null; a document of size 0 has
    copies like any other and adds no words. Null sources are one source, ordered last. The
    order within a size class hashes the id, so reruns agree; equal rows change places
    without effect. copies never exceeds ``most``. A source without words has target and
    copies 0. An empty table gives an empty result.
    """
    columns = columns or docs.columns
    id_text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = bounded(docs).select(
        whole_row(columns),
        F.col(id_col).alias("id"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        _source_key(F.col(source_col)).alias("key"),
        F.md5(id_text).alias("hash"),
    )
    if text_col not in columns:
        rows = written(rows)  # counting words is most of the work; do it once
    goals = targets(rows.select("key", "size"), weights, most)
    at = _placed(rows).join(goals, "key")
    upto = lambda place: F.floor(F.col("rate") * place + F.col("offset"))
    copies = F.least(upto(F.col("place") + 1) - upto(F.col("place")), F.lit(most))
    return at.select("row", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as it was drawn (not at all, or up to ``most`` times), with the columns of docs, whatever their names.

    Rows with a null or blank text are drawn like others of size 0; a null source is a source; rows
    that repeat are drawn one by one; an empty table stays empty (see ``mixed``).
    """
    drawn = mixed(docs, **options).where("copies > 0")
    return drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


#: The query's rows for DuckDB.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k, md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
w AS (SELECT *, (row_number() OVER (ORDER BY (k = 'n'), k) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER f, 0)::DOUBLE)
             / ((sum(weight) OVER ())::DOUBLE - coalesce(sum(weight) OVER f, 0)::DOUBLE) AS level0
      FROM w WINDOW f AS (ORDER BY cap::DOUBLE / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, max(CASE WHEN level0 * weight <= cap THEN level0 END) OVER () AS level FROM l),
t AS (SELECT k, source_size, least(cap::DOUBLE, level * weight) AS target,
             CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE least(cap::DOUBLE, level * weight) / source_size END AS rate,
             ('0x' || substr(md5('offset:' || k), 1, 5))::BIGINT::DOUBLE / 1048576 AS shift
      FROM m),
p AS (SELECT d.*, row_number() OVER (PARTITION BY k ORDER BY length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)), substr(h, 1, 3), h, doc_id, size) - 1 AS place FROM d)
SELECT doc_id, size, source_size, target,
       (least(floor(rate * (place + 1) + shift) - floor(rate * place + shift), 3))::BIGINT * size AS taken
FROM p JOIN t USING (k)
"""
