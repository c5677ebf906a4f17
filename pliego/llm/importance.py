"""Operator 13: resampling towards a target distribution by an external sort-count.

Each text's features are hashed to buckets and written once, as packed streams of 16-bit
bucket numbers with the offsets of their documents. A first scan of the streams sorts each
and encodes its runs, and the runs' lengths are summed to the counts of all buckets; the
target's texts are counted likewise. A bucket's gain is the logarithm of how much more
common it is in the target. A second scan gathers the gains of a stream and sums them
between the offsets (np.add.reduceat). A draw without replacement takes the highest scores
(weight plus Gumbel noise), ranked through a range-partitioned sort.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import bounded, whole_row, written

#: Buckets of features; a stream has 16 bits for each.
BUCKETS = 10_000
#: A stream is closed when it has so many features; a longer document has one of its own.
CHUNK = 1 << 19
#: Words whose buckets a task remembers.
_KNOWN = 1 << 17
#: Bytes to bytes: A-Z lower-cased, digits, a-z and all beyond ASCII as they are, the rest spaces.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_STREAM = pa.schema([("ids", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("stream", pa.large_binary())])


class _Buckets(dict):
    """The buckets of features, computed when they are first asked for."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= _KNOWN:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def features(text: bytes, most: int, known: _Buckets) -> tuple[int, np.ndarray]:
    """The number of words, and the buckets of all runs of 1 to ``most`` words."""
    words = text.translate(_WORDS).split(b" ")
    words = [w for w in words if w]
    runs = [np.fromiter(map(known.__getitem__, words), np.uint16, len(words))]
    for k in range(2, most + 1):
        joined = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
        runs.append(np.fromiter(map(known.__getitem__, joined), np.uint16, len(joined)))
    return len(words), np.concatenate(runs)


def streams(rows: DataFrame, most: int, buckets: int, chunk: int = CHUNK) -> DataFrame:
    """(ids, words, offsets, stream) of rows (id, text): the packed bucket streams, each with the offsets where its documents begin, and its length."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(buckets)
        ids, words, offsets, parts = [], [], [0], []

        def closed() -> pa.RecordBatch:
            stream = np.concatenate(parts).astype("<u2").tobytes()
            return pa.RecordBatch.from_pydict({"ids": [ids], "words": [words], "offsets": [offsets], "stream": [stream]}, _STREAM)

        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                n, found = features(text.as_py().encode("utf-8", "surrogatepass"), most, known)
                ids.append(i)
                words.append(n)
                parts.append(found)
                offsets.append(offsets[-1] + len(found))
                if offsets[-1] >= chunk or len(ids) >= chunk:
                    yield closed()
                    ids, words, offsets, parts = [], [], [0], []
        if ids:
            yield closed()

    return rows.mapInArrow(packed, "ids array<long>, words array<long>, offsets array<long>, stream binary")


def counts(packed: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs: each stream is sorted and run-length encoded, Spark sums the runs."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream in batch.column("stream"):
                values = np.sort(np.frombuffer(stream.as_py(), "<u2"))
                starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))
                lengths = np.diff(starts, append=len(values))
                yield pa.RecordBatch.from_arrays([pa.array(values[starts].astype(np.int32)), pa.array(lengths.astype(np.int64))], ["bucket", "n"])

    found = packed.select("stream").mapInArrow(runs, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in found.collect():  # one row for each bucket at most
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the source."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    n = len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weights(packed: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, words, n_features, weight): the gains of each document's features, summed."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, words, offsets, stream = (batch.column(c)[row] for c in ("ids", "words", "offsets", "stream"))
                offsets = np.asarray(offsets.values)
                sizes = np.diff(offsets)
                weight = np.zeros(len(sizes), np.int64)
                if (full := sizes > 0).any():
                    weight[full] = np.add.reduceat(gain[np.frombuffer(stream.as_py(), "<u2")], offsets[:-1][full])
                yield pa.RecordBatch.from_arrays([ids.values, words.values, pa.array(sizes), pa.array(weight)], ["doc_id", "words", "n_features", "weight"])

    return packed.mapInArrow(summed, "doc_id long, words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the hash of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, share: int, least: int) -> DataFrame:
    """scored (doc_id, words, score, ...) with rank: of the N rows with ``least`` words or more, floor(share N / 100) get 1, 2, ... by falling score.

    Rows are sorted over range partitions, those that can be drawn first; a row's rank is
    the number of rows in earlier partitions plus its place in its own. Rows that agree in
    score and id are told apart by their place in the table, so they can be split.
    """
    spark = scored.sparkSession
    rows = scored.withColumn("able", F.col("words") >= least).withColumn("row", F.monotonically_increasing_id())
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()).drop("row"))
    part = F.shiftright("place", 33)
    sizes = sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("able").alias("able")).collect())  # one row for each partition
    before, first = 0, []
    for number, n, _ in sizes:
        first.append((number, before))
        before += n
    drawn = share * sum(able for *_, able in sizes) // 100
    starts = spark.createDataFrame(first, "part long, first long")
    at = F.col("first") + (F.col("place") - F.shiftleft("part", 33)) + 1
    out = placed.withColumn("part", part).join(F.broadcast(starts), "part", "left")
    return out.withColumn("rank", F.when(F.col("able") & (at <= drawn), at)).drop("part", "first", "place", "able")


def resampled(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS, seed: int = 2024, share: int = 10, least: int = 20, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, words, n_features, weight, score, rank), one row for each row of docs; rank is null for rows that are not drawn.

    Words are runs of digits, letters a-z (A-Z lower-cased) and signs beyond ASCII, in
    whole texts; features are the runs of 1 to ``most`` words. A null or empty text has no
    features and weight 0. Ties of score go to the smaller id, null ids last; a null id is
    hashed as the empty text. Equal rows are drawn one by one. Without rows in ``target``
    all gains come from smoothing; an empty table gives an empty result. Other columns are
    not read.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a stream has 16 bits for a bucket")
    text = lambda df, c: F.coalesce(df[c].cast("string"), F.lit("")).alias("text")
    rows = bounded(docs).select(docs[id_col].cast("long").alias("id"), text(docs, text_col))
    packed = written(streams(rows, most, buckets, chunk))
    aim = streams(target.select(F.lit(None).cast("long").alias("id"), text(target, target_col)), most, buckets, chunk)
    gain = gains(counts(packed, buckets), counts(aim, buckets))
    scored = weights(packed, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return ranked(written(scored), share, least)


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(row, rank): the drawn rows of docs, whole, in a struct. Rows of one id, null among them, are drawn together, at the best of their ranks."""
    picked = resampled(docs, target, id_col=id_col, **options).where("rank IS NOT NULL").groupBy(F.col("doc_id").alias("drawn")).agg(F.min("rank").alias("rank"))
    held = docs.select(whole_row(docs.columns), F.col(id_col).cast("long").alias("id"))
    return held.join(picked, F.col("id").eqNullSafe(F.col("drawn"))).select("row", "rank")


#: The query's rows for DuckDB. CRC-32 is folded over the bytes of each different word.
ORACLE_SQL = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
  UNION ALL
  SELECT 'b', NULL, NULL, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) FROM benchmark),
tab AS (SELECT list(list_reduce([i::BIGINT] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) g(i)),
flat AS (SELECT side, r, unnest(w) AS f FROM words),
crcs AS (SELECT f, xor(list_reduce([4294967295::BIGINT] || list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i::INT + 1, 2))::BIGINT),
               lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % 10000 AS b FROM (SELECT DISTINCT f FROM flat), tab),
cnt AS (SELECT b, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM flat JOIN crcs USING (f) GROUP BY b),
tot AS (SELECT coalesce(sum(s), 0)::DOUBLE AS ss, coalesce(sum(t), 0)::DOUBLE AS tt FROM cnt),
gain AS (SELECT b, floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::BIGINT AS g FROM cnt, tot),
wgt AS (SELECT r, sum(g)::BIGINT AS weight FROM flat JOIN crcs USING (f) JOIN gain USING (b) WHERE side = 'd' GROUP BY r),
sc AS (SELECT doc_id, r, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
              coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
       FROM words LEFT JOIN wgt USING (r) WHERE side = 'd'),
rk AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS k, count(*) FILTER (n_features >= 20) OVER () AS n FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * n // 100 THEN k END AS rank FROM rk
"""
