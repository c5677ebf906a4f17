"""Editions of an award by year, with their categories and juries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import truthy

# The figures of an edition, and the fields in which a juror is looked for.
STATS = ("participants", "nationalities", "awards_count", "attendees_nit_laus")
JUROR_FIELDS = ("name", "role", "studio_or_context", "category_judged")
NO_CATEGORY = "Sin categoría asignada"


def edition_years(editions: DataFrame) -> DataFrame:
    """The years of editions, latest first; rows without one go."""
    return editions.select("year").where("year is not null").distinct().orderBy(F.col("year").desc())


def edition_summary(editions: DataFrame, categories: DataFrame, juries: DataFrame, label: str) -> DataFrame:
    """One row a year, latest first: the first edition of the year (by pos), title, has_stats, categories, jurors.

    A blank edition_label gives the label with the year. categories and jurors count the rows
    of that year, 0 if there are none; both are counted before the join, so a year with most
    rows is no hot key of it.
    """
    kept = ["edition_label", "status_note", *STATS]
    one = editions.where("year is not null").groupBy("year").agg(F.min_by(F.struct(*kept), "pos").alias("e")).select("year", "e.*")
    for rows, name in ((categories, "categories"), (juries, "jurors")):
        one = one.join(rows.groupBy("year").agg(F.count("*").alias(name)), "year", "left")
    title = F.coalesce(truthy(F.col("edition_label")), F.concat(F.lit(label + " "), F.col("year").cast("string")))
    out = one.withColumns({"title": title, "has_stats": F.coalesce(*STATS).isNotNull(), "categories": F.coalesce("categories", F.lit(0)), "jurors": F.coalesce("jurors", F.lit(0))})
    return out.select("year", "title", "status_note", *STATS, "has_stats", "categories", "jurors").orderBy(F.col("year").desc())


def jurors_found(juries: DataFrame, text: str) -> DataFrame:
    """Jurors one of whose fields holds a text, without regard to case; all if the text is blank."""
    wanted = text.strip().lower()
    if not wanted:
        return juries
    hit = F.lit(False)
    for c in JUROR_FIELDS:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(wanted))
    return juries.where(hit)


def jury_groups(juries: DataFrame) -> DataFrame:
    """juries with ``category``, ``group_pos`` (of the category's first juror in its year) and ``chair``.

    Ordered by year, group_pos and pos they are the groups as shown. The first position of a
    category is aggregated and joined, so that no task sorts a whole category.
    """
    rows = juries.withColumns({"category": F.coalesce(truthy(F.col("category_judged")), F.lit(NO_CATEGORY)), "chair": F.coalesce("is_chair", F.lit(False))})
    firsts = rows.groupBy("year", "category").agg(F.min("pos").alias("group_pos"))
    return rows.alias("r").join(firsts.alias("f"), F.col("r.year").eqNullSafe(F.col("f.year")) & (F.col("r.category") == F.col("f.category"))).select("r.*", "group_pos")
