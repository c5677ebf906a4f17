"""Operators 4, 6 and 9: token counts, mixing, sharding."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pliego.llm import mixing, resharding, tokens


def test_token_counts(edge, texts):
    encode = tokens.encoder(tokens.VOCABULARY).encode_ordinary
    want = sorted(((i, len(encode(t))) for i, t in texts), key=repr)
    for block in (tokens.BLOCK, 64, 2):
        assert sorted(map(tuple, tokens.token_counts(edge, block=block).collect()), key=repr) == want


def test_long_texts_are_cut_where_tokens_end():
    encode = tokens.encoder(tokens.VOCABULARY).encode_ordinary
    r = random.Random(3)
    for _ in range(100):
        text = "".join(r.choice(["ab", " ", "  ", "\n", "é", "12", "'s", ".", "Zz "]) for _ in range(200))
        assert [t for part in tokens.cut_points(text, 7) for t in encode(part)] == encode(text)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 100])
def test_scan_stitches_blocks(spark, block):
    r = random.Random(block)
    rows, want = [], []
    for file in range(4):
        counts = [r.choice([0, 0, 1, 3, 10]) for _ in range(r.randint(0, 12))]
        flat = [t for c in counts for t in [1] * c + [9]] + [1] * (file % 2 * 4)
        want += [(file, k, c) for k, c in enumerate(counts + [4] * (file % 2))]
        data = np.array(flat, "<u2").tobytes()
        rows += [(file, k, bytearray(data[lo : lo + 2 * block])) for k, lo in enumerate(range(0, len(data), 2 * block))]
    df = spark.createDataFrame(rows, "file long, block int, tokens binary")
    assert sorted(map(tuple, tokens.separator_scan(df, end=9).collect())) == sorted(want)


def test_flat_files_on_disk(spark, tmp_path):
    for k, counts in enumerate(([2, 0, 5], [1])):
        (tmp_path / f"{k}.bin").write_bytes(np.array([t for c in counts for t in [3] * c + [50256]], "<u2").tobytes())
    found = tokens.separator_scan(tokens.read_flat_files(spark, str(tmp_path), block=4)).orderBy("file", "ordinal").collect()
    assert [r["n_tokens"] for r in found] == [2, 0, 5, 1]


def poured(sizes, weights, most=3):
    """Targets by pouring and resharing the excess until none is above its cap."""
    total, caps = sum(sizes), [most * s for s in sizes]
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        heft = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / heft > caps[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / heft
            break
        for i in over:
            target[i] = caps[i]
            open_.discard(i)
        left = total - sum(caps[i] for i in range(len(sizes)) if i not in open_)
    return target


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 1000], [1000, 1, 1, 1], [5], [0, 7, 3], [3, 900, 20, 0, 50, 7]])
def test_targets_reshare_the_excess(spark, sizes):
    keys = [f"s{chr(97 + i)}" for i in range(len(sizes))]
    got = {r["key"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(zip(keys, sizes)), "key string, size long")).collect()}
    assert [got[k] for k in keys] == pytest.approx(poured(sizes, list(itertools.islice(itertools.cycle((1, 2, 3)), len(sizes)))))


def test_mix_follows_targets(spark):
    r = random.Random(1)
    rows = [(i, " ".join("w" * 1 for _ in range(r.randint(1, 40))), r.choice(["a", "b", "b", "b", None])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mixed(docs).collect()
    taken, targets = defaultdict(int), {}
    for x in found:
        assert x["size"] == len(x["row"]["text"].split()) and 0 <= x["copies"] <= 3
        taken[x["row"]["source"]] += x["copies"] * x["size"]
        targets[x["row"]["source"]] = x["target"]
    assert all(abs(taken[s] - t) <= 0.01 * t + 60 for s, t in targets.items())
    assert sorted((x["row"]["doc_id"], x["copies"]) for x in mixing.mixed(docs.repartition(7)).collect()) == sorted((x["row"]["doc_id"], x["copies"]) for x in found)
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(docs).count() == sum(x["copies"] for x in found)


def test_mix_agrees_with_sql(spark, edge, tmp_path):
    path = str(tmp_path / "d.parquet")
    edge.coalesce(1).write.parquet(path)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    want = c.sql(f"SELECT {', '.join(cols)} FROM ({mixing.ORACLE_SQL})").fetchall()
    got = mixing.mixed(edge, ["doc_id"]).select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_flow_ships_all_at_least_cost():
    cost = [[1, 4, 2], [3, 1, 5], [2, 2, 2]]
    flow = resharding.min_cost_flow([3, 2, 1], [2, 2, 2], cost)
    assert [sum(x) for x in flow] == [3, 2, 1] and [sum(x) for x in zip(*flow)] == [2, 2, 2]
    best = min(
        sum(cost[s][t] for s, t in zip([0, 0, 0, 1, 1, 2], p)) for p in set(itertools.permutations([0, 0, 1, 1, 2, 2]))
    )
    assert sum(cost[s][t] * flow[s][t] for s in range(3) for t in range(3)) == best


def test_shards(edge, texts):
    rows = resharding.resharded(edge, 4).collect()
    assert len(rows) == len(texts)
    by, places = defaultdict(list), defaultdict(set)
    for r in rows:
        data = (r["row"]["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        by[r["shard"]].append(r["slot"])
        places[data].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(4))
    assert all(len(s) == 1 for s in places.values())


def test_shards_are_even_and_moves_few(spark):
    r = random.Random(4)
    docs = spark.createDataFrame([(i, "x" * r.randint(1, 400) + str(i)) for i in range(3000)] + [(5000 + i, "copy" * 50) for i in range(2000)], "doc_id long, text string")
    rows = resharding.resharded(docs, 16).collect()
    load = defaultdict(int)
    for x in rows:
        load[x["shard"]] += x["size"]
    mean = sum(load.values()) / 16
    assert max(load.values()) < 1.02 * mean and min(load.values()) > 0.98 * mean
    old = docs.select("*").limit(0)
    assert resharding.resharded(old, 16).collect() == []
    again = spark.createDataFrame([(x["row"]["doc_id"], x["row"]["text"], x["shard"]) for x in rows], "doc_id long, text string, was int")
    moved = resharding.resharded(again, 16, old="was").where("old <> shard").agg(F.sum("size")).first()[0] or 0
    assert moved < 0.02 * sum(load.values())


def test_rewrite_touches_only_affected_shards(spark, tmp_path):
    path = str(tmp_path / "out")
    docs = spark.createDataFrame([(i, "x" * (50 if i < 30 else 1), i % 3) for i in range(90)], "doc_id long, text string, was int")
    docs.withColumn("shard", F.col("was")).withColumn("slot", F.lit(0).cast("long")).write.partitionBy("shard").parquet(path)
    sharded = resharding.resharded(docs, 3, capacities=None, old="was")
    touched = resharding.rewrite(sharded, path)
    moved = sharded.where("old <> shard").count()
    assert spark.read.parquet(path).count() == 90 and (moved == 0) == (touched == [])


def fewest_bytes(loads, capacities):
    """The fewest units that must move until no shard is above its capacity, by trying all plans of single units."""
    todo = [tuple(loads)]
    seen, moved = {tuple(loads)}, 0
    while todo:
        if any(all(x <= c for x, c in zip(state, capacities)) for state in todo):
            return moved
        nxt = set()
        for state in todo:
            for s in range(len(state)):
                for t in range(len(state)):
                    if s != t and state[s]:
                        now = list(state)
                        now[s], now[t] = now[s] - 1, now[t] + 1
                        nxt.add(tuple(now))
        todo, moved = list(nxt - seen), moved + 1
        seen |= nxt
    raise AssertionError


def test_no_plan_moves_fewer_bytes():
    r = random.Random(5)
    for _ in range(40):
        n = r.randint(2, 4)
        blocks = [(r.randrange(n), k, 0, 1) for k in range(r.randint(1, 9))]
        loads = [sum(b[3] for b in blocks if b[0] == s) for s in range(n)]
        caps = [len(blocks) // n + (i < len(blocks) % n) for i in range(n)]
        moves = resharding.transfers(blocks, n)
        after = [sum(1 for b in blocks if moves.get(b[:3], b[0]) == s) for s in range(n)]
        assert all(x <= c for x, c in zip(after, caps)) and len(moves) == fewest_bytes(loads, caps)


def test_uneven_blocks_move_no_more_than_the_flow():
    r = random.Random(6)
    for _ in range(30):
        n = r.randint(2, 6)
        blocks = [(r.randrange(n), k, 0, r.randint(1, 60)) for k in range(400)]
        total = sum(b[3] for b in blocks)
        caps = [total // n + (i < total % n) for i in range(n)]
        loads = [sum(b[3] for b in blocks if b[0] == s) for s in range(n)]
        moves = resharding.transfers(blocks, n)
        size = {b[:3]: b[3] for b in blocks}
        after = [sum(b[3] for b in blocks if moves.get(b[:3], b[0]) == s) for s in range(n)]
        assert sum(size[k] for k in moves) <= sum(max(0, x - c) for x, c in zip(loads, caps))
        assert all(x <= c + 60 * n for x, c in zip(after, caps))


def test_rewrite_leaves_no_old_copy_in_an_emptied_shard(spark, tmp_path):
    path = str(tmp_path / "out")
    docs = spark.createDataFrame([(i, f"text {i}", i % 3) for i in range(30)], "doc_id long, text string, was int")
    docs.withColumn("shard", F.col("was")).withColumn("slot", F.lit(0).cast("long")).write.partitionBy("shard").parquet(path)
    resharding.rewrite(resharding.resharded(docs, 3, capacities=[10_000, 10_000, 0], old="was"), path)
    rows = spark.read.parquet(path).select("doc_id", "shard").collect()
    assert sorted(r[0] for r in rows) == list(range(30)) and {r[1] for r in rows} == {0, 1}


def test_old_shards_that_are_none(spark):
    docs = spark.createDataFrame([(i, f"text number {i}", (None, -3, 99, 0, 1)[i % 5]) for i in range(500)], "doc_id long, text string, was int")
    rows = resharding.resharded(docs, 4, old="was").collect()
    load = Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    assert len(rows) == 500 and set(load) == set(range(4)) and max(load.values()) < 1.05 * min(load.values()) and {r["old"] for r in rows} == {None, -3, 99, 0, 1}


def test_empty(empty):
    assert tokens.token_counts(empty).collect() == [] and mixing.mixed(empty).collect() == []
