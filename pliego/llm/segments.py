"""Anchored segments as Spark tables, shared by the two operators on exact repeats.

A segment row says where a segment lies, its anchor, the digest of its content and whether
one of its windows recurs inside it. Rows are short, so the shuffles by anchor stay far
below the size of the text; text is fetched only for the first copy of contents that share
an anchor with other contents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import segments
from .base import batch_bytes, dropped, salted_join, written

_SEGMENT = "doc_id long, th binary, start long, windows int, anchor long, digest long, weight int"
_FIELDS = [x.split()[0] for x in _SEGMENT.split(", ")]
#: Bytes of text that are laid out at once, but for longer documents.
_HELD = 1 << 18


def texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (x.as_buffer().to_pybytes() for x in batch.column("text").cast(pa.large_binary()))


class Layout(NamedTuple):
    """Documents laid out as items: item i of the buffer is view[starts[i]:ends[i]], document d has
    the items [offsets[d], offsets[d + 1]). A run of items is one slice of the view."""

    view: bytes
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray

    def slicer(self) -> Callable[[int, int], bytes]:
        starts, ends, view = self.starts.tolist(), self.ends.tolist(), self.view
        return lambda lo, hi: view[starts[lo] : ends[hi - 1]]


_TABLE = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0xC2B2AE3D27D4EB4F)  # odd, so that it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 2**64))


@lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.multiply.accumulate(np.append(np.uint64(1), np.full(size - 1, x))) for x in (_BASE, _INVERSE))


class ByteItems:
    """Documents as sequences of bytes."""

    k = 64

    def layout(self, data: np.ndarray, offsets: np.ndarray) -> Layout:
        place = np.arange(len(data) + 1)
        return Layout(data.tobytes(), place[:-1], place[1:], offsets, _TABLE[data])


class WordItems:
    """Documents as sequences of words; in the view one space stands between the words of a document.

    A word's hash serves only to choose anchors: it is a polynomial of its bytes, taken from
    running sums over the whole buffer.
    """

    k = 5

    def layout(self, data: np.ndarray, offsets: np.ndarray) -> Layout:
        if not len(data):
            none = np.zeros(0, np.int64)
            return Layout(b"", none, none, np.zeros_like(offsets), none.view(np.uint64))
        space = (data == 32) | ((data >= 9) & (data <= 13))
        filled = offsets[:-1][offsets[1:] > offsets[:-1]]
        after_space = np.append(True, space[:-1])
        after_space[filled] = True
        before_space = np.append(space[1:], True)
        before_space[filled - 1] = True  # the byte before a document; for the first one that is the last byte of all
        first, last = np.flatnonzero(~space & after_space), np.flatnonzero(~space & before_space)
        keep = ~(space & after_space)
        place = np.cumsum(keep) - 1
        view = np.where(space, np.uint8(32), data)[keep].tobytes()
        size = 1 << max(10, int(len(data) - 1).bit_length())
        power, inverse = _powers(size)
        sums = np.cumsum(np.where(space, np.uint64(0), _TABLE[data]) * power[: len(data)])
        hashes = (sums[last] - sums[first] + _TABLE[data[first]] * power[first]) * inverse[first]
        return Layout(view, place[first], place[last] + 1, np.searchsorted(first, offsets), hashes)


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about _HELD bytes, at least one document each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _HELD, side="right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def segment_rows(docs: DataFrame, kind, window: int, digests: bool = True) -> DataFrame:
    """A row for each segment of docs (columns of base.keyed).

    Without ``digests`` the rows have only anchor and weight.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            data, offsets = batch_bytes(batch.column("text"))
            for lo, hi in _chunks(offsets):
                laid = kind.layout(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                seq, start, count, anchor, weight = segments(laid.hashes, laid.offsets, window, min(kind.k, window))
                item = laid.offsets[seq] + start
                loops = weight > 1
                for j in np.flatnonzero(loops).tolist():
                    at = slice(item[j], item[j] + count[j])
                    ends = laid.ends[at.start + window - 1 : at.stop + window - 1]
                    loops[j] = len({digest(laid.view[a:b]) for a, b in zip(laid.starts[at].tolist(), ends.tolist())}) < count[j]
                weight = pa.array(1 + loops, pa.int32())
                if not digests:
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), weight], ["anchor", "weight"])
                    continue
                own = [digest(laid.view[a:b]) for a, b in zip(laid.starts[item].tolist(), laid.ends[item + count + window - 2].tolist())]
                at = pa.array(seq + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), batch.column("th").take(at), pa.array(start, pa.int64()), pa.array(count, pa.int32()), pa.array(anchor), pa.array(np.array(own, np.uint64).view(np.int64)), weight],
                    _FIELDS,
                )

    return docs.select("doc_id", "th", "text").mapInArrow(run, _SEGMENT if digests else "anchor long, weight int")


def repeated(docs: DataFrame, kind, window: int) -> DataFrame:
    """The segments of docs whose windows may recur, those of an anchor that occurs twice, with ``rows``.

    Rows of docs that agree in id and text give each segment once, with their number. Written out.
    """
    anchors = segment_rows(docs, kind, window, digests=False).groupBy("anchor").agg(F.sum("weight").alias("n")).where("n > 1")
    twice = written(anchors)
    total = twice.agg(F.sum("n")).first()[0] or 0
    found = salted_join(segment_rows(docs, kind, window), twice, ["anchor"], total, ["doc_id", "th"])
    out = written(found.groupBy("anchor", "_salt", *(c for c in _FIELDS if c != "anchor")).agg(F.count("*").alias("rows")).drop("_salt"))
    dropped(twice)
    return out


def contents(found: DataFrame) -> DataFrame:
    """Each distinct segment content: its first place in order of (doc_id, th, start), the ``places``
    where it stands and its ``copies``, repeated rows included."""
    place = F.struct("doc_id", "th", "start")
    return found.groupBy("anchor", "digest").agg(
        F.min(place).alias("source"), F.first("windows").alias("windows"), F.count("*").alias("places"), F.sum("rows").alias("copies"), F.max("weight").alias("weight")
    )


def branching(content: DataFrame) -> DataFrame:
    """(anchor, n): anchors with several contents, or with windows that recur inside one."""
    return content.groupBy("anchor").agg(F.count("*").alias("n"), F.max("weight").alias("weight")).where("n > 1 or weight > 1").select("anchor", "n")


def packed(docs: DataFrame) -> DataFrame:
    """docs (columns of base.keyed) with the text compressed, for shuffles of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            blobs = pa.array([pack.compress(t) for t in texts(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), blobs], ["doc_id", "th", "blob"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th binary, blob binary")


def unpacked(batch: pa.RecordBatch) -> Iterator[bytes]:
    unpack = zstandard.ZstdDecompressor()
    return (unpack.decompress(x.as_buffer()) for x in batch.column("blob"))


def fetched(blobs: DataFrame, content: DataFrame, kind, window: int) -> DataFrame:
    """content with a column piece: the text of each content, read at its first place in blobs (see packed)."""
    lists = content.select("source.*", "windows", "anchor", "digest").groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "windows", "anchor", "digest")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ["anchor", "digest", "doc_id", "th", "start", "windows", "piece"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), unpacked(batch), batch.column("wanted"))
            for doc_id, th, text, wanted in rows:
                cut = kind.layout(np.frombuffer(text, np.uint8), np.array([0, len(text)])).slicer()
                for w in wanted.as_py():
                    s, n = w["start"], w["windows"]
                    for x, value in zip(out, (w["anchor"], w["digest"], doc_id, th, s, n, cut(s, s + n + window - 1))):
                        x.append(value)
                if len(out[0]) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], fields)
                    out = [[] for _ in fields]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], fields)

    first = blobs.join(lists, ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).select("doc_id", "th", "blob", "wanted")
    return first.mapInArrow(run, "anchor long, digest long, doc_id long, th binary, start long, windows int, piece binary")
