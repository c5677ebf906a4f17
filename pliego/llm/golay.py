"""Operator 3: near-duplicates by SimHash fingerprints joined through Golay-code keys.

Two 64-bit fingerprints that differ in at most 3 bits, cut into four segments of 16 bits,
agree in one segment at least, and by pigeonhole at most one segment has 2 or more errors.
A segment (padded with zeros to 23 bits) decodes to a codeword of the perfect Golay code;
its keys are the codewords of all words at distance 1 or less, one to six of them. Segments
that differ in at most one bit then share a key. A key of the join is one exact segment
with a Golay key of the next segment around the ring: whatever the errors, one of the four
pairs (exact, next) has no error in its first and at most one in its second segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import NO_ID, batch_bytes, bounded, dropped, whole_row, written
from .components import components

#: Generator polynomial of the binary Golay code (fixed value): x^11+x^9+x^7+x^6+x^5+x+1.
GENERATOR = 0b101011100011
#: Largest key group whose members are compared with each other.
CROWD = 500
#: Members of crowded groups for which one task lists all values within 2 bits, 2081 each.
BALLS = 256

#: Each byte with A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _syndrome(words: np.ndarray) -> np.ndarray:
    out = words.astype(np.int64)
    for bit in range(22, 10, -1):
        out ^= np.where((out >> bit) & 1, GENERATOR << (bit - 11), 0)
    return out


@cache
def _leaders() -> np.ndarray:
    """The error of at most three bits that each syndrome stands for."""
    bits = 1 << np.arange(23)
    errors = [0, *bits]
    errors += [a ^ b for i, a in enumerate(bits) for b in bits[:i]]
    errors += [a ^ b ^ c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
    errors = np.array(errors)
    leader = np.zeros(1 << 11, np.int64)
    leader[_syndrome(errors)] = errors
    return leader


def decoded(words: np.ndarray) -> np.ndarray:
    """The index of the codeword nearest to each word of 23 bits."""
    return (words ^ _leaders()[_syndrome(words)]) >> 11


@cache
def _segment_codewords() -> np.ndarray:
    return decoded(np.arange(1 << 16))


def codewords(fp: np.ndarray) -> np.ndarray:
    """The codeword indices of a fingerprint's four segments, 12 bits each, as one number."""
    table, out = _segment_codewords(), np.zeros(len(fp), np.int64)
    for i in range(4):
        out = (out << 12) | table[(fp >> np.uint64(16 * i)).astype(np.int64) & 0xFFFF]
    return out


@cache
def segment_keys() -> tuple[np.ndarray, np.ndarray]:
    """Keys of all 2^16 segments: (keys, offsets), the keys of x at [offsets[x], offsets[x+1])."""
    x = np.arange(1 << 16)
    ball = np.stack([x, *(x ^ (1 << i) for i in range(16))], axis=1)
    words = np.sort(decoded(ball), axis=1)
    fresh = np.append(np.ones((len(x), 1), bool), words[:, 1:] != words[:, :-1], axis=1)
    return words[fresh], np.append(0, fresh.sum(axis=1).cumsum())


def votes_of(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    return np.unpackbits(np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def simhash(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    return int(np.packbits(2 * votes_of(hashes) > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_rows(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            data, offsets = batch_bytes(batch.column("text"))
            data, offsets = LOWER[data].tobytes(), offsets.tolist()
            out = np.zeros(len(batch), np.uint64)
            for i in range(len(batch)):
                words = data[offsets[i] : offsets[i + 1]].split()
                if not words:
                    continue
                joined = b" ".join(words)
                at = np.append(0, np.cumsum([len(w) + 1 for w in words]))
                ends = at[shingle:] - 1 if len(words) >= shingle else at[-1:] - 1
                total, votes = len(ends), np.zeros(64, np.int64)
                for lo in range(0, total, 1 << 16):
                    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(at[lo : lo + (1 << 16)].tolist(), ends[lo : lo + (1 << 16)].tolist())], "<u8")
                    votes += votes_of(hashes)
                out[i] = np.packbits(2 * votes > total, bitorder="little").view("<u8")[0]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(out.view(np.int64))], [*(c for c in batch.schema.names if c != "text"), "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the SimHash of each row's text as a long; the sign is the top bit.

    Texts are lower-cased in A-Z; shingles of words count as often as they occur. A text of
    fewer words is one shingle; a null text and one without words has fingerprint 0.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.mapInArrow(_fingerprint_rows(shingle), "doc_id long, fp long")


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, offsets = segment_keys()
    for batch in batches:
        fp = batch.column("fp").to_numpy()
        parts = np.ascontiguousarray(fp).view(np.uint64)
        found = []
        for i in range(4):
            exact = (parts >> np.uint64(16 * i)).astype(np.int64) & 0xFFFF
            near = (parts >> np.uint64(16 * ((i + 1) % 4))).astype(np.int64) & 0xFFFF
            count = offsets[near + 1] - offsets[near]
            row = np.repeat(np.arange(len(fp)), count)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            found.append((row, (np.int64(i) << 28) | (exact[row] << 12) | keys[offsets[near[row]] + inner]))
        row, key = (np.concatenate(x) for x in zip(*found))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """The links that join what the links before them have not joined."""
    top: dict[int, int] = {}
    out: tuple[list[int], list[int]] = ([], [])
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = x, y
        while (r := top.get(p, p)) != p:
            top[p] = p = top.get(r, r)
        while (r := top.get(q, q)) != q:
            top[q] = q = top.get(r, r)
        if p != q:
            top[max(p, q)] = min(p, q)
            out[0].append(x)
            out[1].append(y)
    return out


def _pair_rows(distance: int):
    """Links inside the key groups of a partition sorted by key, compared one distance in the order
    after another. Of a group's links those stay that span its components."""

    def linked(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step, live = 1, np.arange(len(key) - 1)
        while len(live):
            live = live[key[live] == key[live + step]]
            # Counted unsigned: numpy counts the bits of a negative number's absolute value.
            near = np.bitwise_count((fp[live] ^ fp[live + step]).view(np.uint64)) <= distance
            a.append(fp[live[near]])
            b.append(fp[live[near] + step])
            step += 1
            live = live[live + step < len(key)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _forest(np.concatenate(a), np.concatenate(b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            key = np.append(key, batch.column("key").to_numpy())
            fp = np.append(fp, batch.column("fp").to_numpy())
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if cut:
                yield linked(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        if len(key):
            yield linked(key, fp)

    return run


def _ball_rows(radius: int):
    """Each fingerprint with all values within ``radius`` bits of it (1 or 2)."""
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    masks = np.append(np.zeros(1, np.uint64), bits)
    if radius == 2:
        i, j = np.triu_indices(64, 1)
        masks = np.append(masks, bits[i] ^ bits[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                fp = batch.column("fp").to_numpy()[lo : lo + 256]
                near = (np.ascontiguousarray(fp).view(np.uint64)[:, None] ^ masks).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(np.repeat(fp, len(masks)))], ["value", "fp"])

    return run


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (column fp) at 3 or fewer bits.

    Key groups of up to ``crowd`` members are compared member by member; the links that span
    their components are kept. Members of larger
    groups are linked without any list of the group: values within 1 bit of a member and
    values within 2 bits of a member meet in every value halfway, where all are linked to
    one member within 1 bit of it. Those edges span the same components as all links.
    """
    spark = distinct.sparkSession
    keys = written(distinct.mapInArrow(_key_rows, "key long, fp long"))
    sizes = keys.groupBy("key").count().where("count > 1")
    alive = written(keys.join(sizes, "key"))
    dropped(keys)
    small = alive.where(F.col("count") <= crowd).select("key", "fp").repartition("key").sortWithinPartitions("key")
    pairs = small.mapInArrow(_pair_rows(3), "a long, b long")
    crowded = alive.where(F.col("count") > crowd).select("fp").distinct()
    if members := crowded.count():
        tasks = min(-(-members // BALLS), int(spark.conf.get("spark.sql.shuffle.partitions")))
        crowded = crowded.repartition(tasks, "fp")
        hubs = crowded.mapInArrow(_ball_rows(1), "value long, fp long").groupBy("value").agg(F.min("fp").alias("a"))
        # Spark takes a ball for no larger than its member; without the hint it may broadcast all balls by way of the driver.
        halfway = crowded.mapInArrow(_ball_rows(2), "value long, fp long").join(hubs.hint("merge"), "value").select("a", F.col("fp").alias("b"))
        pairs = pairs.unionByName(halfway)
    return pairs.where("a <> b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of docs.

    fingerprint has 16 lowercase hex digits; component_id is the smallest doc_id that can be
    reached over links of 3 or fewer differing bits. Null and wordless texts share
    fingerprint 0, which links like any other. A null doc_id never is the smallest unless
    its component has no other id; the component is null then. Repeated rows stay, an empty
    table gives an empty result, other columns are not read.
    """
    rows = written(fingerprints(docs, shingle, id_col, text_col))
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = components(links(distinct.select("fp"), crowd)).withColumnRenamed("node", "fp")
    member = distinct.join(linked, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = member.groupBy("component").agg(F.min("least").alias("component_id"))
    named = member.join(least, "component").select("fp", "component_id")
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(named, "fp").select("doc_id", fingerprint, "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near-duplicates: one row of each component stays, that with its smallest id.

    Rows that share the smallest id are one document repeated, of which one stays. A row
    with a null id goes by a hash of its text, before all ids. All columns are kept.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(text), 2))
    rows = docs.select(whole_row(docs.columns), key.alias("key"), text.alias("text"))
    found = near_duplicates(rows, shingle, crowd, "key")
    first = written(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("key")).agg(F.count("*").alias("n")))
    kept = rows.drop("text")
    single = kept.join(first.where("n = 1"), "key", "left_semi")
    # The window holds only rows that share an id.
    again = Window.partitionBy("key").orderBy(F.xxhash64("row"))
    repeated = kept.join(first.where("n > 1"), "key", "left_semi").withColumn("again", F.row_number().over(again)).where("again = 1").drop("again")
    return single.unionByName(repeated).select("row.*")
