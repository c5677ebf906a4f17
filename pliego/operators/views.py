"""What a table view, a map and a period panel ask for: filters with parameters, order, pages, counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.notices import display_status, is_new, mapped, status_key
from ..functions.semantics import any_kw, norm_ws, period_key, third
from ..functions.tables import SAMPLE, TERRITORIES
from ..sources.exports import file_manifest, verified_files
from .records import ui_order

#: Stands for rows without any discipline in a choice of disciplines.
NO_DISCIPLINE = "__none__"


@dataclass(frozen=True)
class Filters:
    """The choices of a view; an empty one filters nothing, and all must hold."""

    status: str = ""
    active_only: bool = False
    ccaa: str = ""
    year: str = ""
    disciplines: Sequence[str] = ()
    new_only: bool = False
    query: str = ""
    awardee: str = ""


#: The choices that a view opens with.
INITIAL = Filters(active_only=True)


def _text(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def with_display(rows: DataFrame, as_of: datetime) -> DataFrame:
    """rows (estat_raw, estat, data_limit) with ``display``, the status to show at a moment."""
    return rows.withColumn("display", display_status(F.col("estat_raw"), F.col("estat"), F.col("data_limit"), as_of))


def any_discipline(chosen: Sequence[str], column: str = "disciplines") -> Column:
    """Whether a row has one of the chosen disciplines, or none where NO_DISCIPLINE is chosen."""
    own = F.coalesce(F.col(column), F.array().cast("array<string>"))
    tagged = [d for d in chosen if d != NO_DISCIPLINE]
    hit = F.arrays_overlap(own, F.array(*map(F.lit, tagged))) if tagged else F.lit(False)
    return hit | (F.size(own) == 0) if NO_DISCIPLINE in chosen else hit


def filtered(rows: DataFrame, f: Filters, as_of: datetime) -> DataFrame:
    """The rows (with_display, ccaa, data_pub, disciplines, titol, organisme, kw, adjudicatari, active) that all filters let through."""
    tests = []
    if f.status:
        tests.append(F.col("display") == status_key(F.lit(f.status)))
    if f.active_only:
        tests.append(F.coalesce("active", F.lit(False)))
    if f.ccaa:
        tests.append(F.col("ccaa") == f.ccaa)
    if f.year:
        tests.append(F.coalesce("data_pub", F.lit("")).startswith(f.year))
    if f.disciplines:
        tests.append(any_discipline(f.disciplines))
    if f.new_only:
        tests.append(is_new(F.col("data_pub"), as_of))
    if f.query:
        q = f.query.lower()
        in_words = F.exists(F.coalesce("kw", F.array().cast("array<string>")), lambda k: F.lower(k).contains(q))
        tests.append(_text("titol").contains(q) | _text("organisme").contains(q) | in_words)
    if f.awardee:
        tests.append(_text("adjudicatari").contains(f.awardee.lower()))
    for t in tests:
        rows = rows.where(t)
    return rows


def panel_base(rows: DataFrame, f: Filters) -> DataFrame:
    """The rows of the period panel: all filters but the period, by stored status."""
    rows = rows.where(F.col("ccaa") == f.ccaa) if f.ccaa else rows
    return map_rows(rows, f)


def map_rows(rows: DataFrame, f: Filters) -> DataFrame:
    """The rows of the map: by stored status and disciplines, over all states of a procurement."""
    rows = rows.where(F.col("estat") == f.status) if f.status else rows
    tagged = [d for d in f.disciplines if d != NO_DISCIPLINE]
    return rows.where(any_discipline(tagged)) if f.disciplines else rows


def period_rows(rows: DataFrame, year: int, third: int, date: str = "data_pub") -> DataFrame:
    return rows.where(period_key(F.to_date(F.col(date))) == f"{year}-C{third}")


def resolved_period(rows: DataFrame, date: str = "data_pub", year: int | None = None, third: int | None = None) -> DataFrame:
    """(year, third): the chosen period; what is not chosen is the last that has rows."""
    day = F.to_date(F.col(date))
    parts = rows.select(F.year(day).alias("year"), (F.floor((F.month(day) - 1) / 4) + 1).cast("int").alias("third")).where("year is not null")
    parts = parts.where(F.col("year") == year) if year else parts
    last = F.max(F.struct("year", "third"))
    found = parts.agg(last.alias("p")).select(F.coalesce("p.year", F.lit(year)).alias("year"), F.coalesce("p.third", F.lit(1)).alias("third"))
    return found.withColumn("third", F.lit(third)) if third else found


def neighbour_period(year: int, third: int, step: int, first: int, last: int) -> tuple[int, int]:
    """The period ``step`` thirds on, kept within the years first to last."""
    at = min(max(year * 3 + third - 1 + step, first * 3), last * 3 + 2)
    return at // 3, at % 3 + 1


def ordered(rows: DataFrame, column: str, text: bool = False, descending: bool = False, tie: str = "id") -> DataFrame:
    """Open rows first, then by a column with missing values last; ties by ``tie``."""
    tier = F.when(F.col("display") == "open", 0).otherwise(1)
    return rows.orderBy(*ui_order(tier, column, text, descending), tie)


def page(rows: DataFrame, number: int, size: int, column: str, text: bool = False, descending: bool = False, tie: str = "id") -> DataFrame:
    """A page (from 1) of the ordered rows, with ``total`` rows and ``pages``; beyond the last page it is the last one.

    The count and the page are two jobs over one filter; the page itself is a top-k, never a full sort.
    """
    total = rows.count()
    pages = max(1, -(-total // size))
    number = min(max(number, 1), pages)
    chosen = ordered(rows, column, text, descending, tie).limit(number * size).offset((number - 1) * size)
    return chosen.withColumns({"page": F.lit(number), "pages": F.lit(pages), "total": F.lit(total).cast("long")})


def first_rows(rows: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows in an order; 0 is all of them."""
    rows = rows.orderBy(*order)
    return rows.limit(n) if n else rows


def year_range(rows: DataFrame, date: str = "data_pub") -> DataFrame:
    """(first, last): the first and last year of a date text."""
    year = F.nullif(F.regexp_extract(F.coalesce(F.col(date), F.lit("")), r"^(\d{4})", 1), F.lit(""))
    return rows.agg(F.min(year).alias("first"), F.max(year).alias("last"))


def activity(rows: DataFrame, as_of: datetime, days: int = 3) -> DataFrame:
    """(total, open, active, fresh): rows shown as open, eligible, and published in the last days."""
    return rows.agg(
        F.count("*").alias("total"), F.count_if(F.col("display") == "open").alias("open"), F.count_if(F.coalesce("active", F.lit(False))).alias("active"), F.count_if(is_new(F.col("data_pub"), as_of, days)).alias("fresh")
    )


def with_states(rows: DataFrame, ident: str = "id") -> DataFrame:
    """rows with ``states``, the number of rows of their id: a grouped count joined back, so no group is held."""
    return rows.join(rows.groupBy(ident).agg(F.count("*").alias("states")), ident, "left")


def tiers(spark: SparkSession, path: str, priority: dict[int, Sequence[str]], whole: str, form: str = "parquet", manifest: DataFrame | None = None):
    """The shards of one priority after another, each as a DataFrame read from its folders alone.

    If a shard is missing or has damaged files, the whole data set at ``whole`` is the one and
    only tier. Damage shows in listing and footers, or, with a ``manifest`` (file_manifest of
    what was written), in any byte: then all files are read once and compared before any
    tier is given out.
    """
    found = []
    try:
        for level in sorted(priority):
            found.append(spark.read.format(form).option("basePath", path).load([f"{path}/shard={s}" for s in priority[level]]))
        sound = manifest is None or not verified_files(file_manifest(spark, path, "shard"), manifest).where("state <> 'ok'").take(1)
    except PySparkException as e:
        if e.getCondition() == "DATA_SOURCE_NOT_FOUND":
            raise
        sound = False
    except Py4JJavaError:
        sound = False
    yield from found if sound else [spark.read.format(form).load(whole)]


def text_filter(rows: DataFrame, query: str, columns: Sequence[str]) -> DataFrame:
    """Rows with a text in any of the columns, without regard to case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | _text(c).contains(query.lower())
    return rows.where(hit) if query else rows


def keyword_filter(rows: DataFrame, text: Column, keywords: Sequence[str]) -> DataFrame:
    return rows.where(any_kw(norm_ws(text), list(keywords)))


def or_sample(spark: SparkSession, read: Callable[[], DataFrame], today: str) -> tuple[DataFrame, bool]:
    """What read gives, or the sample notices if it cannot be read; and whether it is the sample. A notice without a date was published today."""
    try:
        return read(), False
    except PySparkException:
        rows = spark.createDataFrame([(*r[:7], r[7] or today, *r[8:]) for r in SAMPLE], "id string, titol string, organisme string, adjudicatari string, pressupost double, disciplines array<string>, ccaa string, data_pub string, data_limit string, estat string, rellevancia int")
        return rows.withColumn("lloc", mapped(TERRITORIES, F.col("ccaa"))), True


def statistics_rows(rows: DataFrame, year: str = "", ccaa: str = "", status: str = "", disciplines: Sequence[str] = (), period: int = 0) -> DataFrame:
    """The rows of the statistics: by year alone, territory, stored status, any of the disciplines, and third of whatever year."""
    tests = [(year, F.coalesce("data_pub", F.lit("")).startswith(year)), (ccaa, F.col("ccaa") == ccaa), (status, F.col("estat") == status)]
    for chosen, test in tests:
        rows = rows.where(test) if chosen else rows
    rows = rows.where(any_discipline(disciplines)) if disciplines else rows
    return rows.where(third(F.try_to_date(F.left("data_pub", F.lit(10)))) == period) if period else rows
