"""Texts as lines: pages carried forward, windows of lines, fields found after headings, text quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import fold_accents


def lines(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, line_no, raw, fold): the lines of each text, numbered from 0."""
    rows = docs.select(ident, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "raw"))
    return rows.withColumn("fold", fold_accents(F.regexp_replace(F.col("raw"), r"\(cid:\d+\)", "")))


def with_pages(rows: DataFrame, ident: str, marker: str = r"^--- PAGE (\d+) ---$", first: int = 1) -> DataFrame:
    """rows with page, from the last page marker at or above the line; marker lines go."""
    number = F.regexp_extract("raw", marker, 1)
    w = Window.partitionBy(ident).orderBy("line_no")
    page = F.last(F.when(number != "", number.cast("int")), ignorenulls=True).over(w)
    return rows.withColumn("page", F.coalesce(page, F.lit(first))).where(number == "")


def windows_after(rows: DataFrame, ident: str, heading: Column, k: int, stop: Column | None = None) -> DataFrame:
    """Heading lines with ``window``: the next k lines, up to the next line where ``stop`` holds."""
    w = Window.partitionBy(ident).orderBy("line_no").rowsBetween(1, k)
    ahead = F.collect_list(F.struct(F.col("raw").alias("raw"), F.coalesce(stop if stop is not None else F.lit(False), F.lit(False)).alias("stop"))).over(w)
    found = rows.withColumn("_h", F.coalesce(heading, F.lit(False))).withColumn("_ahead", ahead).where("_h")
    first_stop = F.array_position(F.transform("_ahead", lambda x: x["stop"]), True)
    kept = F.when(first_stop > 0, F.slice("_ahead", 1, first_stop.cast("int") - 1)).otherwise(F.col("_ahead"))
    return found.withColumn("window", F.array_join(F.transform(kept, lambda x: x["raw"]), " ")).drop("_h", "_ahead")


def best_window(rows: DataFrame, ident: str, richness: Column, is_heading: Column) -> DataFrame:
    """The window of each text with the highest richness, headings first by 400; the first on a tie."""
    score = richness + F.when(is_heading, 400).otherwise(0)
    return rows.groupBy(ident).agg(F.max_by(F.struct("line_no", "window"), F.struct(score, -F.col("line_no"))).alias("b")).select(ident, "b.*")


def text_quality(text: Column, pages: Column) -> Column:
    """missing, empty, low_coverage (long documents with little text) or usable."""
    chars = F.length(F.trim(text))
    return F.when(text.isNull(), "missing").when(chars == 0, "empty").when((pages >= 10) & ((chars / pages < 150) | (chars < 1500)), "low_coverage").otherwise("usable")
