"""Connected components of an edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import dropped, hot_join, written

#: Edges that a task turns into stars at once.
BLOCK = 1 << 18


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges (a, b) as stars: each node but the least of its component, and that least node."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends.reshape(2, -1)
    least = np.arange(len(nodes))
    while True:
        x, y = least[a], least[b]
        if (x == y).all():
            break
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least != (further := least[least])).any():
            least = further
    moved = least != np.arange(len(nodes))
    return nodes[moved], nodes[least[moved]]


def _star_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), BLOCK):
            found = stars(*(batch.column(i).slice(lo, BLOCK).to_numpy(zero_copy_only=False) for i in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): each node of edges (a, b) with the least node it can reach.

    Before the rounds each task turns blocks of its edges into stars, so that fewer rounds
    are left; they end when all edges are stars. Both ends of a star are grouped with min(), which combines before the shuffle, and the
    least neighbour of a hub is broadcast to its edges (see hot_join), so a hub with very
    many neighbours is no single task's list. Each round is written out and the one before
    deleted. Edges that still change after ``rounds`` rounds raise an error.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    now = written(edges.mapInArrow(_star_rows, "a long, b long").distinct())
    for done in range(rounds + 1):
        total, settled = _state(now)
        if settled:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        if done == rounds:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
        # Large star: every larger neighbour of a node moves to the node's least neighbour.
        large = written(hot_join(both, low, ["a"], 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # Small star: the smaller neighbours of a node, and itself, move to the least of them.
        small = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        moved = hot_join(large, small, ["a"], 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(moved.unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        dropped(now, large)
        now = after
    raise RuntimeError(f"components have not settled in {rounds} rounds")


def _state(x: DataFrame) -> tuple[int, bool]:
    """The number of edges (a, b), and whether they are stars: each a has one b, and no b is an a."""
    ends = x.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(x.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    edges, most, mixed = nodes.agg(F.sum("up"), F.max("up"), F.count_if((F.col("up") > 0) & (F.col("n") > F.col("up")))).first()
    return edges or 0, not edges or (most == 1 and not mixed)
