"""Operator 13: the draw against a direct computation."""

import hashlib
import math
import re
import zlib

import duckdb
import pytest

from pliego.llm import importance as I


def direct(rows, target, most=1, buckets=10000, seed=2024, share=10, least=20):
    def features(text):
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, most + 1) for i in range(len(words) - k + 1)]

    s, t = [0] * buckets, [0] * buckets
    held = [(i, *features(text)) for i, text in rows]
    for _, _, fs in held:
        for b in fs:
            s[b] += 1
    for text in target:
        for b in features(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    scored = []
    for i, n, fs in held:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in fs)
        scored.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in scored if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    return [(*x, k + 1 if k < share * len(able) // 100 else None) for k, x in enumerate(able)] + [(*x, None) for x in scored if x[1] < least]


@pytest.fixture(scope="module")
def target(spark, texts):
    return spark.createDataFrame([(1, texts[0][1]), (2, None), (3, "ONE two é1")], "item_id long, text string")


@pytest.mark.parametrize("options", [{}, {"share": 50, "most": 3}, {"share": 100, "least": 0, "seed": 7}, {"buckets": 7, "share": 60}])
@pytest.mark.parametrize("chunk", [I.CHUNK, 3])
def test_draw_as_computed_directly(edge, texts, target, options, chunk):
    found = I.resampled(edge, target, chunk=chunk, **options)
    want = direct(texts, [r["text"] for r in target.collect()], **options)
    assert sorted(map(tuple, found.select("doc_id", "words", "n_features", "weight", "score", "rank").collect()), key=repr) == sorted(want, key=repr)


def test_drawn_rows_are_whole(edge, target):
    found = I.draw(edge, target, share=30)
    ranks = {(r["doc_id"]): r["rank"] for r in I.resampled(edge, target, share=30).where("rank IS NOT NULL").collect()}
    assert found.select("row.*").columns == edge.columns and {r["row"]["doc_id"] for r in found.collect()} == set(ranks)


def test_empty_tables(spark, edge, empty, target):
    assert I.resampled(empty, target).count() == 0
    assert I.resampled(edge, empty, target_col="text").count() == edge.count()
    with pytest.raises(ValueError):
        I.resampled(edge, target, buckets=1 << 17)


def test_agrees_with_sql(edge, target, tmp_path):
    c = duckdb.connect()
    for name, df in (("documents", edge), ("benchmark", target)):
        df.coalesce(1).write.parquet(str(tmp_path / name))
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path / name}/*.parquet'")
    cols = ["doc_id", "n_features", "weight", "score", "rank"]
    want = c.execute(f"SELECT {', '.join(cols)} FROM ({I.ORACLE_SQL})").fetchall()
    assert sorted(map(tuple, I.resampled(edge, target).select(*cols).collect()), key=repr) == sorted(want, key=repr)


def test_ranks_over_many_partitions(spark):
    rows = [(i % 50 if i % 3 else None, i % 30, i % 7) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, words long, score long")
    got = sorted((r["rank"], -r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in I.ranked(df, 25, 10).where("rank IS NOT NULL").collect())
    able = sorted((-s, d is None, d or 0) for d, w, s in rows if w >= 10)
    assert [g[1:] for g in got] == able[: len(able) // 4] and [g[0] for g in got] == list(range(1, len(able) // 4 + 1))


