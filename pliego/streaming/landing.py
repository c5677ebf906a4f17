"""Incremental runs: landed files become micro-batches that update a retained table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def landed(spark: SparkSession, path: str, schema: str, form: str = "json", files_per_run: int | None = None) -> DataFrame:
    """A stream of the files that land in a folder."""
    reader = spark.readStream.schema(schema).format(form)
    if files_per_run:
        reader = reader.option("maxFilesPerTrigger", files_per_run)
    return reader.load(path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


class Snapshots:
    """A retained table as numbered versions in a folder; a version is written whole, then named current.

    A run that is repeated after a failure writes the same version again, so each
    micro-batch counts once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, before: int) -> DataFrame | None:
        """The last version below a number, None before the first. A log that cannot be read is an error."""
        log = f"{self.path}/log"
        if not _exists(self.spark, log):
            return None
        last = self.spark.read.schema("version long").parquet(log).where(F.col("version") < before).agg(F.max("version")).first()[0]
        return None if last is None else self.spark.read.parquet(f"{self.path}/v{last}")

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        self.spark.range(1).select(F.lit(version).cast("long").alias("version")).write.mode("append").parquet(f"{self.path}/log")


def merged_runs(stream: DataFrame, snapshots: Snapshots, merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Merge each micro-batch into the last version: merge(previous, incoming) gives the next one."""

    def run(batch: DataFrame, number: int) -> None:
        incoming = prepare(batch)
        previous = snapshots.read(number)
        snapshots.write(incoming if previous is None else merge(previous, incoming), number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class PartedSnapshots:
    """A retained table in parts by a hash of its key; a version writes the parts that change and names those that stay.

    The log has one row for each part that a version wrote, so the current table is the last
    folder of each part. A run costs as much as the parts that its batch touches, and a run that is
    repeated after a failure writes the same version again. Null keys are a part of their own.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, parts: int = 64):
        self.spark, self.path, self.key, self.parts = spark, path.rstrip("/"), key, parts

    def part(self) -> Column:
        return F.when(F.col(self.key).isNull(), -1).otherwise(F.pmod(F.xxhash64(self.key), F.lit(self.parts))).cast("int")

    def _folders(self, before: int | None = None) -> dict[int, str]:
        """The current folder of each part."""
        if not _exists(self.spark, f"{self.path}/log"):
            return {}
        rows = self.spark.read.schema("part int, version long").option("recursiveFileLookup", True).parquet(f"{self.path}/log")
        rows = rows if before is None else rows.where(F.col("version") < before)
        return {r["part"]: f"{self.path}/v{r['v']}/_part={r['part']}" for r in rows.groupBy("part").agg(F.max("version").alias("v")).collect()}  # one row a part

    def read(self, before: int | None = None, touched: list[int] | None = None) -> DataFrame | None:
        """The table, or the parts of it that are touched; None if there is nothing."""
        folders = [f for p, f in sorted(self._folders(before).items()) if touched is None or p in touched]
        return self.spark.read.parquet(*folders) if folders else None

    def merge(self, incoming: DataFrame, version: int, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Write a version: merged(previous, incoming) over the parts that incoming touches. Gives those parts."""
        touched = sorted(r[0] for r in incoming.select(self.part().alias("p")).distinct().collect())  # parts at most
        if not touched:
            return []
        previous = self.read(version, touched)
        rows = incoming if previous is None else merged(previous, incoming)
        rows.withColumn("_part", self.part()).write.mode("overwrite").partitionBy("_part").parquet(f"{self.path}/v{version}")
        log = self.spark.createDataFrame([(p, version) for p in touched], "part int, version long").coalesce(1)
        log.write.mode("overwrite").parquet(f"{self.path}/log/v={version:012d}")
        return touched


def merged_parts(stream: DataFrame, snapshots: PartedSnapshots, merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """As merged_runs over a table in parts: a micro-batch rewrites only the parts that it touches.

    merge must go by the key alone and keep every key of both sides, as the rank merge does.
    """

    def run(batch: DataFrame, number: int) -> None:
        snapshots.merge(prepare(batch), number, merge)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The stream without repeats of a key; keys are forgotten after ``late``, so state stays bounded."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, time: str, late: str, size: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums by time window and key, closed once the watermark has passed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
