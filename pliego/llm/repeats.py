"""Operator 1: bytes of long strings that occur more than once, by a run-length index.

Documents are cut into anchored segments (see anchors and segments); only anchors that
occur twice can hold a repeated window. Equal segments collapse first, so thousands of
copies cost one, and are repeated as a whole. The distinct contents that share an anchor
are dealt out by anchor; each task builds run-compressed Burrows-Wheeler indexes over
bounded chunks of them, with sampled run ends, and streams matching statistics that mark
every window with a second occurrence.

An anchor with more than HOT distinct contents (a passage amid ever other text) is not
gathered in one task: its windows are counted one by one by their digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rlbwt
from .anchors import merged
from .base import dropped, hot_join, keyed, public_id, written
from .segments import ByteItems, branching, contents, fetched, packed, repeated, unpacked

#: Distinct contents of one anchor that one task may index together.
HOT = 2000
#: Bytes of text under one index.
CHUNK = 1 << 19


def _index_rows(window: int, chunk: int):
    schema = pa.schema([("anchor", pa.int64()), ("digest", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

    def marks(anchors, digests, pieces) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for anchor, digest, starts in zip(anchors, digests, rlbwt.repeated_starts(pieces, window)):
            lo, hi = merged(starts, starts + 1)
            for x, values in zip(out, ([anchor] * len(lo), [digest] * len(lo), lo.tolist(), hi.tolist())):
                x += values
        return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(out, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], []]
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "piece"))):
                if size >= chunk and row[0] != held[0][-1]:
                    yield marks(*held)
                    held, size = [[], [], []], 0
                if held[0] and row[:2] == (held[0][-1], held[1][-1]):
                    continue  # the same piece again, from repeated rows
                for x, value in zip(held, row):
                    x.append(value)
                size += len(row[2]) + 1
        if held[0]:
            yield marks(*held)

    return run


def _window_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, digest, piece in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "piece"))):
                keys = [xxhash.xxh3_64_intdigest(piece[j : j + window]) for j in range(len(piece) - window + 1)]
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, anchor)), pa.array(np.full(n, digest)), pa.array(np.arange(n), pa.int32()), pa.array(np.array(keys, np.uint64).view(np.int64))],
                    ["anchor", "digest", "lo", "key"],
                )

    return run


def repeated_ranges(docs: DataFrame, blobs: DataFrame, window: int = 200, hot: int = HOT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, th, ranges): the byte ranges of each document that repeated windows cover.

    docs has the columns of base.keyed, blobs those of segments.packed. Ranges may overlap;
    rows that agree in id and text have one row here; documents without any are absent.
    """
    found = repeated(docs, ByteItems(), window)
    content = written(contents(found))
    forks = branching(content)
    pieces = written(fetched(blobs, content.join(forks, "anchor"), ByteItems(), window))
    crowded = forks.where(F.col("n") > hot).select("anchor")
    cold = pieces.join(crowded, "anchor", "left_anti").select("anchor", "digest", "piece").repartition("anchor").sortWithinPartitions("anchor", "digest")
    marks = cold.mapInArrow(_index_rows(window, chunk), "anchor long, digest long, lo int, hi int")
    warm = pieces.join(crowded, "anchor", "left_semi").select("anchor", "digest", "piece").dropDuplicates(["anchor", "digest"])
    single = warm.mapInArrow(_window_rows(window), "anchor long, digest long, lo int, key long")
    again = single.groupBy("anchor", "key").count().where("count > 1").select("anchor", "key")
    marks = marks.unionByName(single.join(again, ["anchor", "key"], "left_semi").select("anchor", "digest", "lo", (F.col("lo") + 1).alias("hi")))
    copied = content.where("copies > 1").select("anchor", "digest", F.lit(0).alias("lo"), F.col("windows").alias("hi"), F.col("places").alias("n"))
    every = marks.withColumn("n", F.lit(1).cast("long")).unionByName(copied)
    marked = written(every.groupBy("anchor", "digest").agg(F.max("n").alias("n"), F.collect_list(F.struct("lo", "hi")).alias("marks")))
    spans = hot_join(found.select("anchor", "digest", "doc_id", "th", "start"), marked, ["anchor", "digest"], found.count())
    span = F.transform("marks", lambda m: F.struct((F.col("start") + m["lo"]).alias("lo"), (F.col("start") + m["hi"] + (window - 1)).alias("hi")))
    ranges = written(spans.select("doc_id", "th", span.alias("own")).groupBy("doc_id", "th").agg(F.flatten(F.collect_list("own")).alias("ranges")))
    dropped(found, content, pieces, marked)
    return ranges


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for text, ranges in zip(unpacked(batch), batch.column("ranges")):
            ranges = ranges.as_py() or []
            s, e = merged(np.array([r["lo"] for r in ranges], np.int64), np.array([r["hi"] for r in ranges], np.int64))
            kept = b"".join(text[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(text)]))
            for x, value in zip(out, (len(text), len(text) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), kept)):
                x.append(value)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(out, types))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, window: int = 200, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Each document without the bytes that a repeated window of ``window`` bytes covers.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes,
    which may cut a multi-byte character). One row for each row of docs.

    A null text counts as empty; texts shorter than the window keep everything; a null id
    stays null. Rows that agree in id and text are repeats of each other, as any two rows
    with one text are. An empty table gives an empty result. Other columns of docs are
    not read.
    """
    docs = keyed(docs, id_col, text_col)
    blobs = packed(docs)
    found = blobs.join(repeated_ranges(docs, blobs, window, **limits), ["doc_id", "th"], "left").select("doc_id", "blob", "ranges")
    out = found.mapInArrow(_kept_rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumn("doc_id", public_id())
