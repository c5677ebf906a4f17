"""Operator 9: minimum-cost-flow resharding.

Documents lie in old shards. Blocks are small sets of documents of one old shard that keep
equal texts together. From the old shards' sizes and the new capacities, each shard keeps
blocks up to its capacity, a minimum-cost flow says how many bytes go from shards above
capacity to shards below it, and whole blocks are picked to carry that flow. Only shards
that give or take blocks are rewritten.

The driver sees one row for each block (at most shards x BUCKETS, and SPLIT for each block
that is larger than a whole shard), never documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .base import bounded, whole_row, written

BUCKETS = 4096
SPLIT = 4096
_CELLS = 64

_MOVES = StructType([StructField("old", IntegerType()), StructField("bucket", IntegerType()), StructField("part", IntegerType()), StructField("new", IntegerType())])


def min_cost_flow(supply: Sequence[int], demand: Sequence[int], cost: Sequence[Sequence[float]]) -> list[list[int]]:
    """flow[s][t] that ships all supply at least cost, by successive shortest paths."""
    n, m = len(supply), len(demand)
    supply, demand = list(supply), list(demand)
    flow = [[0] * m for _ in range(n)]
    far = float("inf")
    while any(supply):
        reach_s = [0.0 if x else far for x in supply]
        reach_t, via_t, via_s = [far] * m, [-1] * m, [-1] * n
        changed = True
        while changed:
            changed = False
            for s in range(n):
                for t in range(m):
                    if reach_s[s] + cost[s][t] < reach_t[t] - 1e-12:
                        reach_t[t], via_t[t], changed = reach_s[s] + cost[s][t], s, True
                    if flow[s][t] and reach_t[t] - cost[s][t] < reach_s[s] - 1e-12:
                        reach_s[s], via_s[s], changed = reach_t[t] - cost[s][t], t, True
        end = min((t for t in range(m) if demand[t]), key=lambda t: reach_t[t], default=None)
        if end is None or reach_t[end] == far:
            break
        path, t = [], end
        while True:
            s = via_t[t]
            path.append((s, t, 1))
            if via_s[s] < 0:
                break
            path.append((s, via_s[s], -1))
            t = via_s[s]
        amount = min([supply[s], demand[end], *(flow[a][b] for a, b, sign in path if sign < 0)])
        for a, b, sign in path:
            flow[a][b] += sign * amount
        supply[s] -= amount
        demand[end] -= amount
    return flow


def transfers(blocks: Sequence[tuple], shards: int, capacities: Sequence[int] | None = None, cost: Sequence[Sequence[float]] | None = None) -> dict[tuple, int]:
    """New shard of each block (old, bucket, part, bytes) that moves: {(old, bucket, part): new}.

    A minimum-cost flow from the old shards' sizes to the capacities (a byte that stays costs
    nothing, one that moves 1, or ``cost``) says how many bytes go from each shard to each
    other. Whole blocks are picked for every such amount, the largest that fit first, so no
    more bytes move than the flow says, and no plan that meets the capacities moves fewer. A
    shard is left above its capacity by less than the smallest block it could have given.
    Blocks without an old shard (outside 0 to shards - 1) go where room is left.
    """
    total = sum(b[3] for b in blocks)
    capacities = list(capacities or [total // shards + (i < total % shards) for i in range(shards)])
    cost = cost or [[0 if s == t else 1 for t in range(shards)] for s in range(shards)]
    held: list[list] = [[] for _ in range(shards)]
    homeless = []
    for b in sorted(blocks, key=lambda b: (-b[3], b[:3])):
        (held[b[0]] if 0 <= b[0] < shards else homeless).append(b)
    load = [sum(b[3] for b in x) for x in held]
    flow = min_cost_flow([*load, sum(b[3] for b in homeless)], capacities, [*cost, [0] * shards])
    place: dict[tuple, int] = {}
    for s in range(shards):
        for t in sorted((t for t in range(shards) if t != s), key=lambda t: -flow[s][t]):
            left, kept = flow[s][t], []
            for b in held[s]:
                if b[3] <= left:
                    left -= b[3]
                    place[b[:3]] = t
                    load[s], load[t] = load[s] - b[3], load[t] + b[3]
                else:
                    kept.append(b)
            held[s] = kept
    for b in homeless:
        t = max(range(shards), key=lambda t: (capacities[t] - load[t], -t))
        place[b[:3]] = t
        load[t] += b[3]
    return place


def resharded(docs: DataFrame, shards: int = 16, capacities: Sequence[int] | None = None, old: str | None = None, columns: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", old_shards: int | None = None) -> DataFrame:
    """(row, size, text_crc32, old, shard, slot), one row for each row of docs.

    ``row`` is a struct of the given columns of docs (all by default). size is the UTF-8
    length plus 1; text_crc32 is that of the text's UTF-8 bytes, of no bytes for null. The
    old shard comes from column ``old``, or from a hash of the text over ``old_shards`` (as
    many as ``shards`` by default); a null, negative or too large one is no shard to stay in. capacities are bytes
    for each shard, equal shares by default. Equal texts stay in one shard unless they
    exceed a whole shard's share; such a group is split by a hash of the id, so one row that is
    repeated beyond a shard's share, id and all, stays one block and its slots one task. slot counts a
    shard's documents from 0 without gaps. Rows that agree in id and text take neighbouring
    slots in any order. An empty table gives an empty result.
    """
    columns = columns or docs.columns
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    h = F.xxhash64(text)
    ident = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    given = F.col(old).cast("long") if old else F.pmod(h, F.lit(old_shards or shards))
    rows = bounded(docs).select(
        whole_row(columns), F.col(id_col).alias("id"), given.alias("given"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.when(given.between(0, shards - 1), given).otherwise(-1).cast("int").alias("old"),
        F.pmod(F.shiftright(h, 8), F.lit(BUCKETS)).cast("int").alias("bucket"), ident.alias("ident"),
    )
    if text_col not in columns:
        rows = written(rows)
    plan, big = _plan(rows, shards, capacities)
    part = F.when((F.col("old") * BUCKETS + F.col("bucket")).isin(big), _part()).otherwise(0) if big else F.lit(0)
    moves = docs.sparkSession.createDataFrame([(*k, v) for k, v in plan.items()], _MOVES)
    moved = rows.withColumn("part", part).join(F.broadcast(moves), ["old", "bucket", "part"], "left").withColumn("shard", F.coalesce("new", "old"))
    block = ["shard", "old", "bucket", "part"]
    cell = [*block, "cell"]
    moved = moved.withColumn("cell", F.pmod(F.shiftright("ident", 40), F.lit(_CELLS)).cast("int"))
    counts = moved.groupBy(*cell).agg(F.count("*").alias("n"))
    # Slots before a cell: those of the shard's earlier blocks, and of the block's earlier cells.
    earlier = Window.partitionBy("shard").orderBy(*block[1:]).rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy(*block).agg(F.sum("n").alias("n")).select(*block, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("block_first"))
    before = Window.partitionBy(*block).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*cell, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("cell_first"))
    starts = starts.join(blocks, block).select(*cell, (F.col("block_first") + F.col("cell_first")).alias("first"))
    inside = Window.partitionBy(*cell).orderBy("text_crc32", "ident", "id", "size")
    slot = (F.col("first") + F.row_number().over(inside) - 1).cast("long")
    return moved.join(starts, cell).select("row", "size", "text_crc32", F.col("given").alias("old"), "shard", slot.alias("slot"))


def _part():
    return F.pmod(F.shiftright("ident", 8), F.lit(SPLIT)).cast("int")


def _plan(rows: DataFrame, shards: int, capacities: Sequence[int] | None) -> tuple[dict[tuple, int], list[int]]:
    blocks = [tuple(r) for r in rows.groupBy("old", "bucket").agg(F.lit(0), F.sum("size")).collect()]
    limit = max(1, sum(b[3] for b in blocks) // shards)
    big = [b[0] * BUCKETS + b[1] for b in blocks if b[3] > limit]
    if big:
        split = rows.where((F.col("old") * BUCKETS + F.col("bucket")).isin(big)).groupBy("old", "bucket", _part()).agg(F.sum("size"))
        blocks = [b for b in blocks if b[3] <= limit] + [tuple(r) for r in split.collect()]
    return transfers(blocks, shards, capacities), big


def rewrite(sharded: DataFrame, path: str) -> list[int]:
    """Write the shards that gave or took documents as path/shard=N; the other folders stay.

    A shard that gave all its documents has no rows to overwrite it, so its folder is deleted.

    sharded is a result of resharded with the old shard of each row. Returns the shards written.
    """
    touched = sharded.where("old is null or old <> shard")
    affected = sorted({r[0] for r in touched.where("old is not null").select("old").distinct().collect()} | {r[0] for r in touched.select("shard").distinct().collect()})
    rows = sharded.where(F.col("shard").isin(affected)).select("row.*", "slot", "shard")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    filled = {r[0] for r in sharded.select("shard").distinct().collect()}
    for shard in set(affected) - filled:
        _delete(sharded.sparkSession, f"{path}/shard={shard}")
    return affected


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
