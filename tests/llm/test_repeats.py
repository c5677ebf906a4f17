"""Operators 1 and 5 against direct searches over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from pliego.llm import debruijn, repeats, rlbwt
from pliego.llm.anchors import segments
from pliego.llm.base import keyed
from pliego.llm.segments import packed


def direct_bytes(texts, window=200):
    data = [t.encode() for _, t in texts]
    seen = Counter(b[p : p + window] for b in data for p in range(len(b) - window + 1))
    out = []
    for (i, _), b in zip(texts, data):
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if seen[b[p : p + window]] > 1:
                gone[p : p + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(bool(g) and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def direct_words(texts, order, window=20):
    seen, out = {}, []
    for i, t in sorted(set(texts), key=order):
        w = t.encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            if k in seen:
                gone[p : p + window] = [True] * window
            seen[k] = True
        out.append((i, t, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def test_segments_cover_each_window_once_and_follow_content():
    rng = np.random.default_rng(0)
    table = rng.integers(0, 2**64, 256, dtype=np.uint64)
    data = rng.integers(97, 100, 6000).astype(np.uint8)
    data[1000:1400], data[4000:4900] = data[3000:3400], 97
    offsets = np.array([0, 0, 150, 350, 351, 2000, 6000])
    found = {}
    for seq, start, n, anchor, _ in zip(*segments(table[data], offsets, 200, 64, block=700)):
        for j in range(n):
            assert (seq, start + j) not in found
            found[seq, start + j] = anchor
    assert set(found) == {(i, p) for i in range(6) for p in range(max(0, offsets[i + 1] - offsets[i] - 199))}
    by = {}
    for (seq, p), anchor in found.items():
        assert by.setdefault(bytes(data[offsets[seq] + p :][:200]), anchor) == anchor


@pytest.mark.parametrize("alphabet", [b"ab", b"abc", b"a", b"ab\xff"])
def test_run_index_and_matching_statistics(alphabet):
    r = random.Random(alphabet)
    for _ in range(40):
        text = bytes(r.choice(alphabet) for _ in range(r.randint(1, 50)))
        a = np.frombuffer(text, np.uint8)
        n = len(text)
        order = rlbwt.suffix_array(a).tolist()
        assert order == sorted(range(n), key=lambda i: text[i:])
        index = rlbwt.build(a)
        assert index.lengths.sum() == n and (index.symbols[1:] != index.symbols[:-1]).all()
        common = lambda i, j: next((k for k in range(n) if max(i, j) + k >= n or text[i + k] != text[j + k]), n)
        assert rlbwt.matching_statistics(index, n).tolist() == [max([common(i, j) for j in range(n) if j != i], default=0) for i in range(n)]


@pytest.mark.parametrize("limits", [{}, {"hot": 1}, {"chunk": 1}])
def test_bytes_of_repeats(edge, texts, limits):
    got = repeats.remove_repeats(edge, **limits).drop("kept").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(direct_bytes(texts), key=repr)


@pytest.mark.parametrize("limits", [{}, {"hot": 1}])
def test_words_of_earlier_passages(spark, edge, limits):
    rows = edge.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.hash(F.coalesce("text", F.lit(""))).alias("h")).collect()
    place = {(r.doc_id, r.t): (r.doc_id is not None, r.doc_id or 0, r.h) for r in rows}
    want = {(x[0], x[1]): (x[0], *x[2:]) for x in direct_words([(r.doc_id, r.t) for r in rows], place.__getitem__)}
    got = debruijn.remove_repeated_spans(edge, **limits).drop("kept").collect()
    assert sorted(map(tuple, got), key=repr) == sorted((want[r.doc_id, r.t] for r in rows), key=repr)


def test_random_words(spark):
    r = random.Random(5)
    texts = [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 60)))) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = debruijn.remove_repeated_spans(df, window=6).drop("kept").collect()
    assert sorted(map(tuple, got)) == sorted((x[0], *x[2:]) for x in direct_words(texts, lambda x: x[0], 6))


def test_paths_compact_into_one_span_for_each_copy(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("aeioulrstn") for _ in range(r.randint(3, 8)))
    passage = [word() for _ in range(600)]
    texts = [(i, " ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)])) for i in range(4)]
    docs = keyed(spark.createDataFrame(texts, "doc_id long, text string"))
    blobs = packed(docs)
    paths = debruijn.repeated_paths(docs, blobs)
    spans = [tuple(x) for x in debruijn.compacted(paths, 20).select("doc_id", "lo", "words", "s_doc", "s_lo").collect()]
    assert sorted(spans) == [(i, 30, 600, 0, 30) for i in (1, 2, 3)] and paths.count() > 3 * len(spans)


def test_only_words_that_the_source_has_are_removed():
    words = [f"w{i}" for i in range(60)]
    blob = zstandard.ZstdCompressor().compress(" ".join(words).encode())
    right = debruijn._digest([w.encode() for w in words[5:30]])
    for digest, removed in ((right, 25), (right[::-1], 0)):
        batch = pa.RecordBatch.from_pylist([{"doc_id": 1, "blob": blob, "ranges": [{"lo": 5, "words": 25, "digest": digest}]}])
        assert [b.column("n_removed").to_pylist() for b in debruijn._kept_rows([batch])] == [[removed]]


def test_repeated_rows_cost_no_more_ranges(spark):
    r = random.Random(10)
    text = "".join(r.choice("abcdefgh ") for _ in range(3000))
    docs = keyed(spark.createDataFrame([(1, text)] * 40 + [(2, text[:1500])], "doc_id long, text string"))
    rows = {x["doc_id"]: x["ranges"] for x in repeats.repeated_ranges(docs, packed(docs)).collect()}
    one = {x["doc_id"]: x["ranges"] for x in repeats.repeated_ranges(docs.dropDuplicates(), packed(docs.dropDuplicates())).collect()}
    assert set(rows) == {1, 2} and len(rows[1]) <= 3 * len(one[1]) + 60
    got = repeats.remove_repeats(docs.drop("th")).collect()
    assert len(got) == 41 and {(x["n_bytes"], x["n_removed"]) for x in got} == {(3000, 3000), (1500, 1500)}
    assert {(x["doc_id"], x["n_removed"]) for x in debruijn.remove_repeated_spans(docs.drop("th"), window=5).collect()} == {(1, 0), (2, len(text[:1500].split()) - (text[1500] != " " and text[1499] != " "))}


def test_empty_tables(empty):
    assert repeats.remove_repeats(empty).collect() == [] and debruijn.remove_repeated_spans(empty).collect() == []


@pytest.fixture(scope="module")
def colliding(spark):
    """Two texts with one 32-bit hash, and a third document that copies a part of one of them."""
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(40)), lambda k: F.md5(F.concat_ws(":", "id", k))), " ")
    made = spark.range(250_000).select("id", F.hash(words).alias("h"))
    ids = made.groupBy("h").agg(F.collect_list("id").alias("ids")).where("size(ids) > 1").orderBy("h").first()["ids"][:2]
    one, two = (r["t"] for r in spark.range(250_000).where(F.col("id").isin(ids)).select(words.alias("t")).collect())
    return [(None, one), (None, two), (5, one[400:1100] + " and more"), (None, passage_of(one, two)), (6, two)]


def passage_of(one, two):
    return one[:500] + " between " + two[600:]


def test_texts_of_one_hash_under_null_ids(spark, colliding):
    docs = spark.createDataFrame(colliding, "doc_id long, text string").repartition(3)
    got = repeats.remove_repeats(docs).drop("kept").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(direct_bytes(colliding), key=repr)
    order = {r["text"]: r["th"] for r in keyed(docs).collect()}
    want = [x[:1] + x[2:] for x in direct_words(colliding, lambda r: (r[0] is not None, r[0] or 0, bytes(order[r[1]])))]
    got = debruijn.remove_repeated_spans(docs).drop("kept").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
