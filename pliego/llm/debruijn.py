"""Operator 5: words of long passages that occurred before, by a compacted de Bruijn graph.

Edges of the graph are token k-mers, that is windows of ``window`` words. Documents are cut
into anchored segments (super-k-mers that share a minimiser, see anchors), so an edge is
looked for only where its anchor occurs twice, and equal segments collapse into one before
any edge is laid out: a later copy of a segment is a path of repeated edges as it stands.
The first copies of anchors with several contents are dealt out by anchor, and each task
compacts the nonbranching paths of its anchors.

Paths end at the borders of their segments. A join of path ends with path starts, on the
coordinates of the path and of its source, compacts them into long spans: a span lies in one
document and runs in step with its source, which lies before it. Spans, not edges, are then
verified: the words at the source's coordinates are read and digested (128 bits), and a span
is removed only where its own words have that digest.

An anchor with more than HOT contents is not gathered in one task: its edges get their
forks and sources from a grouped count and a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .anchors import merged
from .base import bucketed, dropped, hot_join, keyed, public_id, written
from .segments import WordItems, branching, contents, fetched, packed, repeated, unpacked


#: Distinct contents of one anchor that one task may compact together.
HOT = 2000
_PATH = "doc_id long, th binary, lo long, n long, s_doc long, s_th binary, s_at long"


def _keys(piece: bytes, count: int, window: int) -> list[int]:
    # A piece is words joined by one space, so its windows are slices of it.
    ends = [i for i, c in enumerate(piece) if c == 32] + [len(piece)]
    starts = [0, *(e + 1 for e in ends)]
    return [xxhash.xxh3_64_intdigest(piece[a:b]) for a, b in zip(starts, ends[window - 1 : window - 1 + count])]


def _compacted(group: list[tuple], window: int) -> list[tuple]:
    """Paths of one anchor: group has (doc_id, th, start, windows, piece) for each content."""
    group = sorted(set(group))
    keyed_group = [(doc, th, start, _keys(piece, n, window)) for doc, th, start, n, piece in group]
    after: dict[int, int] = {}
    before: dict[int, int] = {}
    forks, joints = set(), set()
    for _, _, _, keys in keyed_group:
        for a, b in zip(keys, keys[1:]):
            if after.setdefault(a, b) != b:
                forks.add(a)
            if before.setdefault(b, a) != a:
                joints.add(b)
    source: dict[int, tuple] = {}
    out: list[tuple] = []
    for doc, th, start, keys in keyed_group:
        path = None  # first word, windows, first source, last source
        for at, key in enumerate(keys, start):
            own = (doc, th, at)
            first = source.setdefault(key, own)
            if first == own:
                step = False
            else:
                step = path is not None and keys[at - start - 1] not in forks and key not in joints and first == (*path[3][:2], path[3][2] + 1)
            if step:
                path = (path[0], path[1] + 1, path[2], first)
                continue
            if path:
                out.append((doc, th, path[0], path[1], *path[2]))
            path = None if first == own else (at, 1, first, first)
        if path:
            out.append((doc, th, path[0], path[1], *path[2]))
    return out


def _path_rows(window: int):
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    names = [x.split()[0] for x in _PATH.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * len(types), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        anchor, out = None, []
        for batch in batches:
            for now, *row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "th", "start", "windows", "piece"))):
                if now != anchor:
                    out += _compacted(held, window)
                    anchor, held = now, []
                held.append(tuple(row))
            if len(out) >= 20_000:
                yield batch_of(out)
                out = []
        yield batch_of(out + _compacted(held, window))

    return run


def _edge_rows(window: int):
    """The k-mers of each piece in order, each with the one before and the one after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, starts = batch.column("windows").to_numpy(), batch.column("start").to_numpy()
            keys = [k for piece, n in zip(batch.column("piece").to_pylist(), counts.tolist()) for k in _keys(piece, n, window)]
            key = np.array(keys, np.uint64).view(np.int64)
            row = np.repeat(np.arange(len(counts)), counts)
            place = np.arange(len(key)) - np.repeat(np.cumsum(counts) - counts, counts)
            before = pa.array(np.append(key[:1], key[:-1]), mask=place == 0)
            after = pa.array(np.append(key[1:], key[:1]), mask=place == counts[row] - 1)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("anchor").take(at), pa.array(key), batch.column("doc_id").take(at), batch.column("th").take(at), pa.array(starts[row] + place), before, after],
                ["anchor", "key", "doc_id", "th", "at", "before", "after"],
            )

    return run


def repeated_paths(docs: DataFrame, blobs: DataFrame, window: int = 20, hot: int = HOT) -> DataFrame:
    """(doc_id, th, lo, n, s_doc, s_th, s_at): windows lo to lo + n of a document that run in step
    with the windows from s_at on of an earlier place. Each window lies in one path at most."""
    found = repeated(docs, WordItems(), window)
    content = written(contents(found))
    sources = content.where("places > 1").select("anchor", "digest", "source", F.col("places").alias("n"))
    later = hot_join(found, sources, ["anchor", "digest"], found.count()).where(F.struct("doc_id", "th", "start") != F.col("source"))
    copied = later.select("doc_id", "th", F.col("start").alias("lo"), F.col("windows").cast("long").alias("n"), F.col("source.doc_id").alias("s_doc"), F.col("source.th").alias("s_th"), F.col("source.start").alias("s_at"))
    forks = branching(content)
    pieces = written(fetched(blobs, content.join(forks, "anchor"), WordItems(), window))
    crowded = forks.where(F.col("n") > hot).select("anchor")
    cold = pieces.join(crowded, "anchor", "left_anti").drop("digest").repartition("anchor").sortWithinPartitions("anchor")
    edges = pieces.join(crowded, "anchor", "left_semi").mapInArrow(_edge_rows(window), "anchor long, key long, doc_id long, th binary, at long, before long, after long")
    paths = written(copied.unionByName(cold.mapInArrow(_path_rows(window), _PATH)).unionByName(_edge_paths(edges)))
    dropped(found, content, pieces)
    return paths


def _edge_paths(edges: DataFrame) -> DataFrame:
    """The paths of crowded anchors: edges that recur, compacted where they run in step with their source."""
    graph = edges.groupBy("anchor", "key").agg(
        F.min(F.struct("doc_id", "th", "at")).alias("source"),
        F.coalesce(F.min("after") != F.max("after"), F.lit(False)).alias("fork"),
        F.coalesce(F.min("before") != F.max("before"), F.lit(False)).alias("joint"),
    )
    seen = edges.select("anchor", "key", "doc_id", "th", "at").join(graph, ["anchor", "key"]).where(F.struct("doc_id", "th", "at") != F.col("source"))
    order = Window.partitionBy("doc_id", "th").orderBy("at")
    p = F.lag(F.struct("at", "source", "fork")).over(order)
    in_step = (
        (F.col("at") == F.col("p.at") + 1) & ~F.col("p.fork") & ~F.col("joint") & (F.col("source.doc_id") == F.col("p.source.doc_id"))
        & (F.col("source.th") == F.col("p.source.th")) & (F.col("source.at") == F.col("p.source.at") + 1)
    )
    marked = seen.withColumn("p", p).withColumn("path", F.sum(F.when(in_step, 0).otherwise(1)).over(order))
    paths = marked.groupBy("doc_id", "th", "path").agg(F.min("at").alias("lo"), F.count("*").alias("n"), F.min("source").alias("s"))
    return paths.select("doc_id", "th", "lo", "n", F.col("s.doc_id").alias("s_doc"), F.col("s.th").alias("s_th"), F.col("s.at").alias("s_at"))


def compacted(paths: DataFrame, window: int) -> DataFrame:
    """(doc_id, th, lo, words, s_doc, s_th, s_lo): paths joined end to start where both they and
    their sources go on, as ranges of words."""
    ends = paths.select("doc_id", "th", (F.col("lo") + F.col("n")).alias("lo"), "s_doc", "s_th", (F.col("s_at") + F.col("n")).alias("s_at"), F.lit(1).alias("goes_on"))
    joined = paths.join(ends, ["doc_id", "th", "lo", "s_doc", "s_th", "s_at"], "left")
    order = Window.partitionBy("doc_id", "th").orderBy("lo")
    spans = joined.withColumn("span", F.sum(F.when(F.col("goes_on") == 1, 0).otherwise(1)).over(order))
    spans = spans.groupBy("doc_id", "th", "span").agg(F.min("lo").alias("lo"), F.sum("n").alias("n"), F.min_by(F.struct("s_doc", "s_th", "s_at"), "lo").alias("s"))
    return spans.select("doc_id", "th", "lo", (F.col("n") + (window - 1)).alias("words"), "s.s_doc", "s.s_th", F.col("s.s_at").alias("s_lo"))


def _digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _source_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    for batch in batches:
        out: list[list] = [[] for _ in types]
        for doc_id, th, text, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), unpacked(batch), batch.column("wanted")):
            words = text.split()
            for w in wanted.as_py():
                lo, count = w["s_lo"], w["words"]
                for x, value in zip(out, (doc_id, th, lo, count, w["n"], _digest(words[lo : lo + count]))):
                    x.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], ["s_doc", "s_th", "s_lo", "words", "n", "digest"])


def with_source_digests(spans: DataFrame, blobs: DataFrame) -> DataFrame:
    """spans with ``digest``, that of the words at the coordinates of the source."""
    ranges = spans.groupBy("s_doc", "s_th", "s_lo", "words").agg(F.count("*").alias("n"))
    lists = ranges.groupBy(F.col("s_doc").alias("doc_id"), F.col("s_th").alias("th")).agg(F.collect_list(F.struct("s_lo", "words", "n")).alias("wanted"))
    sources = blobs.join(lists, ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).select("doc_id", "th", "blob", "wanted")
    digests = written(sources.mapInArrow(_source_rows, "s_doc long, s_th binary, s_lo long, words long, n long, digest binary"))
    return hot_join(spans, digests, ["s_doc", "s_th", "s_lo", "words"], spans.count())


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, digests, kept_texts = [], [], [], []
        for text, ranges in zip(unpacked(batch), batch.column("ranges").to_pylist()):
            words = text.split()
            sure = [(r["lo"], r["lo"] + r["words"]) for r in ranges or () if _digest(words[r["lo"] : r["lo"] + r["words"]]) == r["digest"]]
            kept = words
            if sure:
                s, e = merged(*(np.array(x) for x in zip(*sure)))
                kept = [w for a, b in zip([0, *e.tolist()], [*s.tolist(), len(words)]) for w in words[a:b]]
            joined = b" ".join(kept)
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(joined).hexdigest())
            kept_texts.append(joined)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
        )


def remove_repeated_spans(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Each document without the words that a window seen earlier covers.

    Returns doc_id, n_words, n_removed, kept_sha256 and kept (the remaining words, joined by
    one space). One row for each row of docs.

    A null text counts as empty; texts of fewer words than the window keep everything; a
    null id sorts before all others and stays null. Rows that agree in id and text are one
    document, so neither is earlier; rows of one id with different texts are ordered by a
    hash of the text. An empty table gives an empty result. Other columns are not read.
    """
    docs = keyed(docs, id_col, text_col)
    blobs = bucketed(packed(docs), ["doc_id", "th"])  # three joins read the texts; none shuffles them
    paths = repeated_paths(docs, blobs, window, **limits)
    spans = written(compacted(paths, window))
    dropped(paths)
    sure = with_source_digests(spans, blobs).groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "words", "digest")).alias("ranges"))
    found = blobs.join(sure, ["doc_id", "th"], "left").select("doc_id", "blob", "ranges")
    out = found.mapInArrow(_kept_rows, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out.withColumn("doc_id", public_id())
