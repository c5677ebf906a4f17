"""What the operators share: inputs, row identity and written intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a missing document id inside the operators.
NO_ID = -(2**63)

#: A word, wherever a contract speaks of words.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of a batch that goes to a Python worker, and rows of a batch that a Parquet reader decodes.
BATCH_BYTES, READER_ROWS = 4 << 20, 1024


#: The settings that bounded() changes; Spark reads them when a result is computed.
_SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES, "spark.sql.parquet.columnarReaderBatchSize": READER_ROWS}


def bounded(df: DataFrame) -> DataFrame:
    """df, after its session was told to keep batches of long texts small.

    Memory for a batch then depends on BATCH_BYTES and the longest text, not on the mean
    length of texts. A smaller value that the user has set stays. Results are computed
    later, so the settings stay too, until ``restored``.
    """
    conf = df.sparkSession.conf
    for key, most in _SMALL_BATCHES.items():
        now = conf.get(key, None)
        if now is None or not now.isdigit() or int(now) > most:
            _BEFORE.setdefault((id(df.sparkSession), key), now)
            conf.set(key, most)
    return df


_BEFORE: dict[tuple[int, str], str | None] = {}


def restored(spark: SparkSession) -> None:
    """Give the session the batch settings back that it had before its first operator."""
    for key in _SMALL_BATCHES:
        if (id(spark), key) in _BEFORE:
            before = _BEFORE.pop((id(spark), key))
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(columns: list[str]) -> Column:
    """A struct ``row`` of columns, whatever their names: dots, spaces and backticks are part of them."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`").alias(c) for c in columns)).alias("row")


def mapped_whole(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """df after mapInArrow with a function that keeps its columns, whose names do not matter: f sees c0, c1, ..."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.mapInArrow(f, plain.schema).toDF(*df.columns)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns (doc_id, th, text): th, 128 bits, tells rows of one id with different texts apart.

    A null text counts as empty, a null id as NO_ID. Rows that agree in id and text
    are one document to the operators that use this key. Other columns are left out,
    so their names cannot clash.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return bounded(docs).select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.unhex(F.concat(F.lpad(F.hex(F.hash(text).cast("long") + (1 << 31)), 8, "0"), F.left(F.md5(text), F.lit(24)))).alias("th"),
        text.alias("text"),
    )


def public_id(column: str = "doc_id"):
    """The id as the caller gave it."""
    return F.nullif(F.col(column), F.lit(NO_ID)).alias(column)


def work_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    A local session that names none gets a temporary folder as its checkpoint directory. On
    a cluster that would scatter the parts over the executors' own disks, so it is an error.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pliego-"))
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/pliego-{uuid.uuid4().hex}"


@contextmanager
def _swept(spark: SparkSession) -> Iterator[None]:
    """Within, Spark deletes a query's shuffle files when the query ends, as its result is on disk then."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and losing an
    executor costs nothing that was computed before. The folder goes when the
    application ends, or with ``dropped``.
    """
    spark = df.sparkSession
    path = work_dir(spark)
    with _swept(spark):
        df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_lies_at"] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that no later result reads."""
    for df in tables:
        if path := df.__dict__.pop("_lies_at", None):
            _remove(df.sparkSession, path)


def hot_join(rows: DataFrame, keyed: DataFrame, on: list[str], total: int, most: int = 1000) -> DataFrame:
    """rows joined to keyed, which has one row for each key with ``n``, the key's number of rows.

    Keys with more than total / most of the ``total`` rows are at most ``most``; they are
    broadcast, so that no task gets all rows of such a key. The others are shuffled.
    """
    limit = max(1, total // most)
    hot, cold = keyed.where(F.col("n") > limit).drop("n"), keyed.where(F.col("n") <= limit).drop("n")
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(cold, on))


def salted_join(rows: DataFrame, keyed: DataFrame, on: list[str], total: int, spread_by: list[str], most: int = 1000) -> DataFrame:
    """As hot_join, in one pass over rows: a key with more than total / most rows gets several
    parts, to which its rows are dealt by a hash of ``spread_by``; the part is column _salt.
    """
    limit = max(1, total // most)
    hot = keyed.where(F.col("n") > limit).select(*on, F.ceil(F.col("n") / limit).alias("_parts"))
    left = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    parts = F.when(F.col("n") > limit, F.ceil(F.col("n") / limit)).otherwise(1).cast("int")
    right = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    return left.join(right, [*on, "_salt"])


def bucketed(df: DataFrame, keys: list[str]) -> DataFrame:
    """df as a bucketed table in the shared folder: joins on the keys then move only their other side."""
    spark = df.sparkSession
    path, name, parts = work_dir(spark), f"pliego_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _swept(spark):
        df.repartition(parts, *keys).write.bucketBy(parts, *keys).option("path", path).saveAsTable(name)
    atexit.register(_forget, spark, name, path)
    return spark.table(name)


def _forget(spark: SparkSession, name: str, path: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # the session has ended, and its list of tables with it
        pass
    _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; the folder goes with the application's storage
        pass


def batch_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and the offsets of its values."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
