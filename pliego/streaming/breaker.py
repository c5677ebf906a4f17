"""Runs over a stream of candidates that stop when too much fails, and go on where they stopped.

A micro-batch is attempted as a whole and its results are written under its number, so a
batch that is repeated after a crash replaces itself. Errors are counted over the run; too
many in a row, or too large a share, trip the breaker: the batch's results stay, the query
ends, and no later batch is attempted until the run is resumed. What was attempted before,
in this run or an earlier one, is not attempted again.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .landing import _exists


class Tripped(RuntimeError):
    """The breaker is open: the message says why."""


class State(NamedTuple):
    """A run after a batch: attempts, errors (skipped ones too), errors in a row at its end, and why it stopped."""

    batch: int = -1
    run: int = 0
    attempted: int = 0
    errors: int = 0
    streak: int = 0
    reason: str | None = None


_STATE = "batch long, run long, attempted long, errors long, streak long, reason string"


class Attempts:
    """Results and states of runs below a path.

    attempt(rows) gives rows with their status; a status of "error" or "skipped" counts as an
    error, "error" alone for errors in a row.
    """

    def __init__(self, spark: SparkSession, path: str, attempt: Callable[[DataFrame], DataFrame], ident: str, position: str, most_in_a_row: int = 10, most_share: float = 0.3):
        self.spark, self.path, self.attempt = spark, path.rstrip("/"), attempt
        self.ident, self.position, self.most_in_a_row, self.most_share = ident, position, most_in_a_row, most_share

    def results(self) -> DataFrame | None:
        """All results so far, with their batch."""
        return self.spark.read.parquet(f"{self.path}/results") if _exists(self.spark, f"{self.path}/results") else None

    def state(self) -> State:
        """The state after the last batch of the last run."""
        if not _exists(self.spark, f"{self.path}/state"):
            return State()
        rows = self.spark.read.schema(_STATE).option("recursiveFileLookup", True).parquet(f"{self.path}/state")
        last = rows.orderBy(F.desc("run"), F.desc("batch")).select(*State._fields).first()
        return State(*last) if last else State()

    def resume(self) -> State:
        """A new run with no errors yet, after a trip or not."""
        state = self.state()
        return self._keep(State(state.batch, state.run + 1))

    def _keep(self, state: State) -> State:
        self.spark.createDataFrame([tuple(state)], _STATE).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state/run={state.run:06d}/at={state.batch + 1:012d}")
        return state

    def _counted(self, done: DataFrame, before: State) -> tuple[int, int, int, int]:
        """Attempts, errors, the longest row of errors (that of the run before included) and the one at the end; a batch is small enough to be put in order."""
        order = Window.orderBy(self.position, self.ident)
        bad = F.coalesce(F.col("status") == "error", F.lit(False))
        rows = done.select(self.position, self.ident, "status", bad.alias("bad")).withColumn("island", F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        runs = rows.groupBy("island").agg(F.count_if("bad").alias("bad"), F.count("*").alias("n"), F.count_if(F.col("status").isin("error", "skipped")).alias("errors"))
        runs = runs.withColumn("bad", F.col("bad") + F.when(F.col("island") == 0, before.streak).otherwise(0))
        r = runs.agg(F.sum("n"), F.sum("errors"), F.max("bad"), F.max_by("bad", "island"), F.max("island")).first()
        if r[0] is None:
            return 0, 0, before.streak, before.streak
        carried = before.streak if r[4] > 0 and runs.where("island = 0").isEmpty() else 0
        return r[0], r[1], max(r[2], carried), r[3]

    def take(self, batch: DataFrame, number: int) -> None:
        """Attempt a micro-batch; raises Tripped if the breaker is open."""
        before = self.state()
        if before.reason:
            raise Tripped(before.reason)
        if before.batch >= number:
            return  # its results are kept
        folder = f"{self.path}/results/batch={number}"
        earlier = self.results()
        fresh = batch if earlier is None else batch.join(earlier.where(F.col("batch") < number).select(self.ident).distinct(), self.ident, "left_anti")
        self.attempt(fresh).write.mode("overwrite").parquet(folder)
        n, errors, longest, last = self._counted(self.spark.read.parquet(folder), before)
        attempted, failed = before.attempted + n, before.errors + errors
        share = failed / attempted if attempted else 0.0
        reason = f"error_rate={share:.4f} > threshold={self.most_share}" if share > self.most_share else f"consecutive_errors={longest} >= threshold={self.most_in_a_row}" if longest >= self.most_in_a_row else None
        self._keep(State(number, before.run, attempted, failed, last, reason))
        if reason:
            raise Tripped(reason)


def guarded_run(stream: DataFrame, attempts: Attempts, checkpoint: str) -> StreamingQuery:
    """Attempt all that has landed, batch by batch; the query fails with Tripped's reason once the breaker opens.

    Started again with the same checkpoint it stays shut until ``attempts.resume()``; then it
    goes on after the batch that tripped it. A checkpoint and a path belong together: another
    path with an old checkpoint would lack the batches that were taken before.
    """
    return stream.writeStream.foreachBatch(attempts.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
