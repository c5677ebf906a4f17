"""Operator 3: fingerprints, keys, links and components against direct versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pliego.llm import golay
from pliego.llm.components import components, stars


def fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(pairs):
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {x: top(x) for x in parent}


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_each_segment_has_one_to_six_keys():
    _, offsets = golay.segment_keys()
    assert set(np.diff(offsets)) <= set(range(1, 7))


def test_three_bits_always_share_a_key():
    r = random.Random(0)
    values = [r.getrandbits(64) for _ in range(500)]
    others = []
    for v in values:
        for bit in r.sample(range(64), r.randint(0, 3)):
            v ^= 1 << bit
        others.append(v)
    batch = pa.RecordBatch.from_arrays([pa.array([signed(v) for v in values + others], pa.int64())], ["fp"])
    keys = {}
    for b in golay._key_rows([batch]):
        for k, f in zip(b.column("key").to_pylist(), b.column("fp").to_pylist()):
            keys.setdefault(f, set()).add(k)
    assert all(keys[signed(a)] & keys[signed(b)] for a, b in zip(values, others))


def test_links_span_the_components_of_all_pairs(spark):
    r = random.Random(2)
    values = set()
    for _ in range(30):
        v = r.getrandbits(64)
        for _ in range(r.randint(1, 6)):
            values.add(v)
            for bit in r.sample(range(64), r.randint(1, 4)):
                v ^= 1 << bit
    values = sorted(values)
    want = joined([(a, a) for a in values] + [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3])
    groups = sorted(sorted(x for x in values if want[x] == t) for t in set(want.values()))
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    for crowd in (1000, 1):
        pairs = [(r["a"] % 2**64, r["b"] % 2**64) for r in golay.links(df, crowd).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
        got = joined([(a, a) for a in values] + pairs)
        assert sorted(sorted(x for x in values if got[x] == t) for t in set(got.values())) == groups


def test_balls_of_crowded_groups_are_not_broadcast(spark):
    r = random.Random(7)
    center = r.getrandbits(64)
    values = {center}
    while len(values) < 300:
        values.add(center ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    far = {v ^ (2**64 - 1) for v in values}
    df = spark.createDataFrame([(signed(v),) for v in sorted(values | far)], "fp long")
    # 600 members have 1.2 million values within 2 bits, 20 MB and more.
    spark.conf.set("spark.sql.maxBroadcastTableSize", "8m")
    try:
        pairs = [(p["a"] % 2**64, p["b"] % 2**64) for p in golay.links(df, crowd=2).collect()]
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    top = joined(pairs)
    assert {frozenset(x for x in top if top[x] == t) for t in set(top.values())} == {frozenset(values), frozenset(far)}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, x) for x in range(2, 40)] + [(7, 7), (300, 200), (200, 300), (300, 400)]
    want = joined([(a, b) for a, b in edges if a != b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {x: got.get(x, x) for x in want} == want


def test_near_duplicates(edge, texts):
    prints = [(i, fingerprint(t)) for i, t in texts]
    want = joined([(a, a) for _, a in prints] + [(a, b) for _, a in prints for _, b in prints if a < b and (a ^ b).bit_count() <= 3])
    least = {}
    for i, f in prints:
        if i is not None:
            least[want[f]] = min(i, least.get(want[f], i))
    got = sorted(map(tuple, golay.near_duplicates(edge).collect()), key=repr)
    assert got == sorted(((i, f"{f:016x}", least.get(want[f])) for i, f in prints), key=repr)


def test_one_of_each_group_stays(edge, texts):
    kept = golay.one_of_each(edge)
    assert kept.columns == edge.columns
    prints = [fingerprint(t) for _, t in texts]
    want = joined([(a, a) for a in prints] + [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3])
    got = [want[fingerprint(r["text"] or "")] for r in kept.collect()]
    assert len(got) == len(set(got)) == len(set(want.values()))


def test_empty(empty):
    assert golay.near_duplicates(empty).collect() == [] and golay.one_of_each(empty).collect() == []


def test_unsettled_components_raise(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    with pytest.raises(RuntimeError, match="not settled"):
        components(chain, rounds=1)


def test_components_of_stars_take_no_round(spark):
    edges = [(i, x) for i in range(0, 3000, 100) for x in range(i + 1, i + 100)]
    got = components(spark.createDataFrame(edges, "a long, b long"), rounds=0)
    assert {tuple(r) for r in got.collect()} == {(x, i) for i, x in edges}


def test_blocks_of_edges_become_stars():
    rng = np.random.default_rng(3)
    a, b = rng.integers(-40, 400, (2, 300))
    want = joined([(x, x) for x in {*a.tolist(), *b.tolist()}] + list(zip(a.tolist(), b.tolist())))
    got = dict(zip(*(x.tolist() for x in stars(a, b))))
    assert got == {x: t for x, t in want.items() if x != t}
