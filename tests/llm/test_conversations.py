"""Operator 12: cheapest repairs against a search over all edit sequences."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from pliego.llm import conversations as T

SPACE = " \t\n\x0b\x0c\r"
GOAL, START = re.compile("(s?(ua)+)?"), re.compile("s?(ua)*u?")


def direct(rows):
    """The contract's row of a conversation's turns (turn, role, text), by uniform-cost search."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, r, x in rows:
        end = x.rstrip(SPACE)[-1:]
        faults.append("blank" if not end else "duplicate" if (r, x) in seen else "truncated" if end not in ".!?" else "")
        seen.add((r, x))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, letters, i, roles, lines = heapq.heappop(heap)
        if i == len(rows) and GOAL.fullmatch(roles):
            break
        state = i, roles[-1:], roles[:1] == "s" and len(roles) == 1
        if state in done:
            continue
        done.add(state)
        options = [("I", 2, i, r, f"{r}:") for r in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            options.append(("D", 3, i + 1, "", None))
            if faults[i] in ("", "truncated"):
                more = faults[i] == "truncated"
                options.append(("K", more, i + 1, role or "?", f"{role}:{text}"))
                options += [("R", 2 + more, i + 1, r, f"{r}:{text}") for r in ("user", "assistant")]
        for letter, spent, to, role, line in options:
            after = roles + role[:1]
            if START.fullmatch(after):
                heapq.heappush(heap, (cost + spent, letters + letter, to, after, lines if line is None else (*lines, line)))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1] or "?") + (b[1][:1] or "?") not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())


EXTRA = (7, "c", 8)
SCHEMA = "conv_id long, turn long, role string, text string, conv long, place string, `a.b` int"


def made(seed, n):
    r = random.Random(seed)
    texts = ["Yes.", "No", "Why? ", "ok!", "", " \t", None, "And then\n", "é."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "s", "ape"]
    return [(r.choice([k, k, None]) if r.random() < 0.2 else k, r.choice(roles[: r.choice([2, 4, 5, 10])]), r.choice(texts[: r.choice([4, 9])]) if r.random() < 0.4 else f"t{k}" + r.choice([".", ""])) for k in range(n)]


@pytest.fixture(scope="module")
def turns():
    found = {seed: made(seed, 1 + seed % 9) for seed in range(150)}
    found[None] = made(1000, 8)
    found[-1] = [(3, "user", "Same.")] * 40 + [(4, "assistant", "Same.")] * 3
    found[-2] = [(1, "system", "A."), (1, "system", "B.")]
    found[-3] = [(None, None, None)]
    found[-4] = made(1001, 60)
    found[-5] = [(-(2**62), "user", "x" * 100_000), (5, "assistant", "y" * 50_000 + ".")]
    return found


@pytest.mark.parametrize("bits", [T.BLOCK_BITS, 2, 0])
def test_cheapest_edits(spark, turns, bits):
    rows = [(c, *t, *EXTRA) for c, ts in turns.items() for t in ts]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r["conv_id"]: tuple(r)[1:] for r in T.audited(df, df, bits=bits).collect()}
    assert got == {c: direct(ts) for c, ts in turns.items()}


def test_repaired_turns_are_rows(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "user", "Go on"), (1, 2, "user", "Go on")], "conv_id long, turn long, role string, text string")
    lines = T.repair(df).lines.orderBy("place", "part").collect()
    assert [(r["role"], r["text"], r["letter"]) for r in lines] == [("user", "", "I"), ("assistant", "Hi.", "K")]


def test_conversations_without_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "x"), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    nothing = hashlib.sha256().hexdigest()
    assert sorted(map(tuple, T.audited(df, df.limit(0)).collect()), key=repr) == [(1, 0, 0, 0, 0, 0, 0, "", nothing), (None, 0, 0, 0, 0, 0, 0, "", nothing)]
    assert T.audited(df.limit(0), df.limit(0)).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b! c?") for c in (*range(40), None) for t in (*range(5), None)]
    got = T.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t, role, text in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        one = (c, t, "user" if code == 4 else role, "" if code == 1 else "A b c" if code == 2 else text)
        want += [one] * (0 if code == 0 else 2 if code == 3 else 1)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_agrees_with_sql(spark, turns, tmp_path):
    path = str(tmp_path / "c.parquet")
    rows = [(c, *t) for c, ts in turns.items() for t in ts if t[1] != ""]  # SQL has no rule for an empty role
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(path)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    found = T.audited(df, T.damaged(df))
    want = c.execute(f"SELECT {', '.join(found.columns)} FROM ({T.ORACLE_SQL})").fetchall()
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
