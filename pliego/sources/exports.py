"""Sinks for people and other systems: the table export, reports, manifests of written files, guarded paths."""

from __future__ import annotations

import posixpath
from collections.abc import Mapping, Sequence
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the table export, in their order.
EXPORT_COLUMNS = ("titol", "organisme", "estat", "pressupost", "data_limit", "data_pub", "ccaa", "disciplines", "adjudicatari", "url")

_BOM = "\ufeff"


def _cell(name: str, kind: str) -> Column:
    """A value as export text: lists joined by commas, numbers plain and with at most 20 decimals, nothing for null."""
    c = F.col(name)
    if kind.startswith("array"):
        c = F.array_join(c.cast("array<string>"), ",", "")
    elif kind in ("double", "float"):
        plain = F.regexp_replace(c.cast("string").cast("decimal(38,20)").cast("string"), r"\.?0+$", "")
        c = F.when(F.abs(c) >= 1e15, c.cast("string")).when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(plain)
    return F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def export_lines(rows: DataFrame, columns: Sequence[str] = EXPORT_COLUMNS) -> DataFrame:
    """rows with ``line``, the row as a line of the export: all fields quoted, quotes doubled, joined by semicolons.

    Line breaks inside a field stay, as quotes hold them. A column that is absent raises an error.
    """
    kinds = dict(rows.dtypes)
    return rows.withColumn("line", F.concat_ws(";", *(_cell(c, kinds[c]) for c in columns)))


def write_export(rows: DataFrame, path: str, order: Sequence[Column], columns: Sequence[str] = EXPORT_COLUMNS) -> None:
    """The export as text: its part files joined in the order of their names are the file for the user.

    The first line is the byte order mark and the names of the columns, unquoted. Rows are
    sorted by range over all tasks, so no task holds the whole file. Every line ends with a
    line break, the last one too. Without rows there is the first line alone.
    """
    spark = rows.sparkSession
    first = spark.createDataFrame([(_BOM + ";".join(columns), True)], "line string, _first boolean")
    marked = export_lines(rows, columns).withColumn("_first", F.lit(False)).unionByName(first, allowMissingColumns=True)
    marked.orderBy(F.col("_first").desc(), *order).select("line").write.mode("overwrite").text(path)


def file_manifest(spark: SparkSession, path: str, shard: str) -> DataFrame:
    """(shard, file, bytes, sha256) of the data files below a table that ``write_shards`` wrote.

    Files outside a shard's folder have a null shard. Each file is read whole by one task, so
    shards should be written with ``maxRecordsPerFile``; a file above 2 GB
    or one that the file system itself finds damaged raises an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    folder = F.nullif(F.regexp_extract("path", rf"/{shard}=([^/]*)/[^/]*$", 1), F.lit(""))
    return files.select(F.url_decode(folder).alias("shard"), F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def shard_sizes(files: DataFrame) -> DataFrame:
    """(shard, files, bytes, digest) of a file manifest; the digest does not depend on the order of files."""
    return files.groupBy("shard").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.bit_xor(F.xxhash64("file", "sha256")).alias("digest"))


def verified_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(shard, file, state) of files on disk against an earlier manifest: ok, changed, missing or unlisted."""
    m = manifest.select("shard", "file", F.struct("bytes", "sha256").alias("told"))
    f = files.select("shard", "file", F.struct("bytes", "sha256").alias("found"))
    j = m.alias("m").join(f.alias("f"), F.col("m.shard").eqNullSafe(F.col("f.shard")) & (F.col("m.file") == F.col("f.file")), "full_outer")
    state = F.when(F.col("told").isNull(), "unlisted").when(F.col("found").isNull(), "missing").when(F.col("told") == F.col("found"), "ok").otherwise("changed")
    return j.select(F.coalesce("m.shard", "f.shard").alias("shard"), F.coalesce("m.file", "f.file").alias("file"), state.alias("state"))


def safe_output(path: str, root: str, allowed: Sequence[str], forbidden: Sequence[str] = ()) -> str:
    """path relative to root if it lies in an allowed folder there; else ValueError.

    Paths may be URIs: those of another file system than root's are refused, as are those
    that leave root by ``..`` and those named as forbidden. A relative path counts from root.
    """
    base, target = urlsplit(root), urlsplit(path)
    if target.scheme and (target.scheme, target.netloc) != (base.scheme, base.netloc):
        raise ValueError(f"{path} is on another file system than {root}")
    relative = posixpath.relpath(posixpath.join(base.path or "/", target.path), base.path or "/")
    inside = any(relative == a or relative.startswith(a.rstrip("/") + "/") for a in allowed)
    if not inside or relative in forbidden:
        raise ValueError(f"{path} is not in one of {', '.join(allowed)}")
    return relative


def write_reports(reports: Mapping[str, DataFrame], root: str, folder: str) -> None:
    """Each report (conflicts, checks, validations) as JSON lines under root/folder/name, all names checked before any is written."""
    paths = {name: safe_output(f"{folder}/{name}", root, [folder]) for name in reports}
    for name, report in reports.items():
        report.write.mode("overwrite").json(f"{root.rstrip('/')}/{paths[name]}")
