"""Operator 3 for a similarity of texts instead of a distance of fingerprints.

A SimHash of a whole text does not reach a similarity of 0.8 of five-word shingles: such
pairs differ in about 10 of 64 bits, and keys that bear so many errors select nothing. So a
text has ORDERS fingerprints instead, each the SimHash of the SAMPLE shingles that come
first in one of ORDERS hash orders. Each of a fingerprint's four segments is decoded to the
index of its Golay codeword; the four indices are a key of the join. Texts of similarity s
have a sample in common, and so its key, with a chance of about 1 - (1 - s^SAMPLE)^ORDERS,
that is 0.99997 at 0.8. The exact similarity of the shingle sets decides on each pair.

Texts with equal sets are one node. The nodes of a key are first compared with one of them
(another one for each key), then those that are not in one component yet with each other; where
that would be more than CROWD comparisons for a key, its nodes meet through their rarest
shingles instead (prefix filtering): of two sets of the similarity, one of the rarest ninth of
the smaller one is among the rarest fifth of the larger one, so no pair is lost, and a
passage that a crowd of other texts shares brings none of them together.
Before any two sets are read, their sizes and parities are compared: a set's PARITY longs
tell of each bit whether an odd number of its shingles falls on it, so two sets differ in at
least as many shingles as bits. No pair of the similarity is lost by that, and only texts of
pairs that it lets through are fetched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import NO_ID, batch_bytes, bounded, dropped, hot_join, whole_row, written
from .components import components
from .golay import LOWER, codewords, simhash

#: Words of a shingle, and the similarity from which on two texts are near-duplicates.
SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints of a node, and shingles in each.
ORDERS, SAMPLE = 20, 4
#: Longs of a set's parity, of 64 bits each.
PARITY = 8
_BITS = [f"w{i}" for i in range(PARITY)]
#: Members of one group that one task compares with those outside the group's largest component.
DEALT = 5000
#: Comparisons of members that a group may take; one of more goes by rarest shingles.
CROWD = 10**8

_R = np.random.default_rng(5)
_TIMES = _R.integers(0, 1 << 63, ORDERS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _R.integers(0, 1 << 63, ORDERS, np.uint64)


def shingles(data: bytes, shingle: int) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a lower-cased text; a shorter text is one shingle."""
    words = data.split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    at = np.append(0, np.cumsum([len(w) + 1 for w in words]))
    ends = at[shingle:] - 1 if len(words) >= shingle else at[-1:] - 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(at.tolist(), ends.tolist())), np.uint64, len(ends)))


def samples(found: np.ndarray) -> np.ndarray:
    """For each order the SAMPLE hashes that come first in it (all of a smaller set)."""
    n = min(SAMPLE, len(found))
    first, ranks = np.zeros((ORDERS, 0), np.uint64), np.zeros((ORDERS, 0), np.uint64)
    for lo in range(0, len(found), 4096):
        block = found[lo : lo + 4096]
        mixed = block * _TIMES[:, None] + _PLUS[:, None]
        mixed ^= mixed >> np.uint64(32)
        ranks = np.concatenate([ranks, mixed * np.uint64(0x9E3779B97F4A7C15)], axis=1)
        first = np.concatenate([first, np.broadcast_to(block, (ORDERS, len(block)))], axis=1)
        if ranks.shape[1] > n:
            least = np.argpartition(ranks, n - 1, axis=1)[:, :n]
            ranks, first = np.take_along_axis(ranks, least, 1), np.take_along_axis(first, least, 1)
    return first


def sample_keys(found: np.ndarray) -> np.ndarray:
    """The ORDERS keys of a set of hashes, none for an empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    index = codewords(np.array([simhash(s) for s in samples(found)], np.uint64))
    return (np.arange(ORDERS) << 48) | index


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    data, offsets = batch_bytes(batch.column("text"))
    data, offsets = LOWER[data].tobytes(), offsets.tolist()
    return (data[a:b] for a, b in zip(offsets, offsets[1:]))


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.append(0, np.cumsum([len(v) for v in values])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *values])))


def _sketch_rows(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, shingle) for t in _texts(batch)]
            node = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            bits = np.array([parity(s) for s in sets], np.int64).reshape(len(sets), PARITY).T
            marks = [pa.array([len(s) for s in sets], pa.int64()), *(pa.array(np.ascontiguousarray(x)) for x in bits)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("th"), pa.array(node), *marks, _lists([sample_keys(s) for s in sets])], ["key", "th", "node", "size", *_BITS, "keys"])

    return run


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pack = zstandard.ZstdCompressor(level=1).compress
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("th"), pa.array([pack(t) for t in _texts(batch)], pa.binary())], ["key", "th", "blob"])


def parity(found: np.ndarray) -> np.ndarray:
    """Whether an odd number of the hashes falls on each bit, as PARITY longs."""
    odd = np.bincount((found >> np.uint64(40)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _set_rows(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unpack = zstandard.ZstdDecompressor().decompress
            sets = [shingles(unpack(b.as_buffer()), shingle).view(np.int64) for b in batch.column("blob")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), _lists(sets)], ["node", "found"])

    return run


def _side(marks: DataFrame, name: str) -> DataFrame:
    """marks (node, size and parity of each node) with its columns named for one side of a pair."""
    return marks.select(F.col("node").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("size", *_BITS)))


def _possible(similarity: float) -> Column:
    """Whether sizes and parities of a pair (a, b) allow the similarity."""
    sizes = F.col("a_size") + F.col("b_size")
    most = sizes - 2 * F.ceil(sizes * (similarity / (1 + similarity)) - 1e-9)
    differ = F.lit(0)
    for c in _BITS:
        differ = differ + F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}")))
    return (F.abs(F.col("a_size") - F.col("b_size")) <= most) & (differ <= most)


def _sets(nodes: DataFrame, rows: DataFrame, sketches: DataFrame, shingle: int) -> DataFrame:
    """(node, found): the shingle sets of nodes, read from one text of each. Written out."""
    chosen = sketches.select("node", "key", "th").join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("key", "th")).alias("k")).select("node", "k.*")
    packed = rows.mapInArrow(_packed_rows, "key long, th long, blob binary")
    return written(packed.join(chosen, ["key", "th"]).dropDuplicates(["node"]).mapInArrow(_set_rows(shingle), "node long, found array<long>"))


def _verified(pairs: DataFrame, rows: DataFrame, sketches: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets, read from the texts of rows, have at least the similarity. Written out."""
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), rows, sketches, shingle)
    found = lambda name: sets.select(F.col("node").alias(name), F.col("found").alias(f"{name}_found"))
    both = pairs.join(found("a"), "a").join(found("b"), "b").withColumn("n", F.size(F.array_intersect("a_found", "b_found")))
    sure = written(both.where(F.col("n") >= similarity * (F.size("a_found") + F.size("b_found") - F.col("n"))).select("a", "b"))
    dropped(sets)
    return sure


def _mixed(members: DataFrame) -> DataFrame:
    """(group, top, n, pairs): groups of several components, the largest of them, their members and the comparisons with those outside it."""
    counts = members.groupBy("group", "component").agg(F.count("*").alias("c"))
    every = counts.groupBy("group").agg(F.max_by("component", "c").alias("top"), F.max("c").alias("most"), F.count("*").alias("parts"), F.sum("c").alias("n")).where("parts > 1")
    return every.select("group", "top", "n", (F.col("n") * (F.col("n") - F.col("most"))).alias("pairs"))


def _across(members: DataFrame, mixed: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of members (group, node, component) that share one of the mixed groups but no component.

    Of a group's components the largest is only compared with the others, never with itself.
    A large group's members are dealt out over several tasks, each with all members outside
    the largest component.
    """
    top = mixed.select("group", "top", "n", F.ceil(F.col("n") / DEALT).alias("deals"))
    own = hot_join(members, top, ["group"], members.count()).select("group", F.col("node").alias("a"), F.col("component").alias("a_component"), "top", "deals").join(_side(marks, "a"), "a")
    few = own.where("a_component <> top").withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1))).drop("top", "deals")
    every = own.select("group", F.col("a").alias("b"), F.col("a_component").alias("b_component"), "top", F.pmod(F.xxhash64("a"), F.col("deals")).alias("deal"), *(F.col(f"a_{c}").alias(f"b_{c}") for c in ("size", *_BITS)))
    apart = (F.col("a_component") != F.col("b_component")) & ((F.col("b_component") == F.col("top")) | (F.col("a") < F.col("b")))
    on = (few["group"] == every["group"]) & (few["deal"] == every["deal"])
    return few.join(every, on & apart & _possible(similarity)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rarest(sets: DataFrame, similarity: float) -> DataFrame:
    """(shingle, node, size, indexed): the rarest shingles of each set, as many as a similar larger partner needs (about a fifth);
    indexed are those that a similar partner of no smaller size needs (about a ninth). Written out."""
    each = written(sets.select("node", F.size("found").alias("size"), F.explode("found").alias("shingle")))
    counts = each.groupBy("shingle").agg(F.count("*").alias("n")).withColumn("rows", F.col("n"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("rows", "shingle"))
    rare = hot_join(each, counts, ["shingle"], each.count()).withColumn("place", place)
    least = lambda share: F.col("size") - F.ceil(F.col("size") * share - 1e-9) + 1
    out = written(rare.where(F.col("place") <= least(similarity)).select("shingle", "node", "size", (F.col("place") <= least(2 * similarity / (1 + similarity))).alias("indexed")))
    dropped(each)
    return out


def _through_rarest(members: DataFrame, sets: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of members (node, component) of different components that the similarity may hold for, found by their rarest shingles."""
    rare = _rarest(sets, similarity)
    own = rare.join(members, "node").select("shingle", "indexed", F.col("node").alias("a"), F.col("component").alias("a_component")).join(_side(marks, "a"), "a")
    other = own.select("shingle", F.col("a").alias("b"), F.col("a_component").alias("b_component"), *(F.col(f"a_{c}").alias(f"b_{c}") for c in ("size", *_BITS)))
    small = own.where("indexed").drop("indexed")
    meet = (small["shingle"] == other["shingle"]) & (F.col("a_size") <= F.col("b_size")) & (F.col("a_component") != F.col("b_component"))
    return small.join(other, meet & _possible(similarity)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def groups(rows: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """(key, th, component) for each of rows (key, th, text); th tells the texts of one key apart.

    component is the same for texts that can be reached from each other over pairs of at
    least the similarity. Texts without words are one node.
    """
    bits = ", ".join(f"{c} long" for c in _BITS)
    sketches = written(rows.mapInArrow(_sketch_rows(shingle), f"key long, th long, node long, size long, {bits}, keys array<long>"))
    marks = written(sketches.select("node", "size", *_BITS).dropDuplicates(["node"]))
    spread = written(sketches.select("node", "keys").dropDuplicates(["node"]).select("node", F.explode("keys").alias("group")))
    hubs = spread.groupBy("group").agg(F.min_by("node", F.xxhash64("node", "group")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    alive = written(hot_join(spread, hubs, ["group"], spread.count()))
    dropped(spread)
    near = alive.where("node <> hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    near = written(near.join(_side(marks, "a"), "a").join(_side(marks, "b"), "b").where(_possible(similarity)).select("a", "b"))
    first = _verified(near, rows, sketches, shingle, similarity)
    placed = written(alive.join(components(first), "node", "left").select("group", "node", F.coalesce("component", "node").alias("component")))
    dropped(alive)
    mixed = written(_mixed(placed))
    pairs = _across(placed, mixed.where(F.col("pairs") <= crowd), marks, similarity)
    crowded = mixed.where(F.col("pairs") > crowd).select("group", "n")
    if crowded.take(1):
        members = written(hot_join(placed, crowded, ["group"], placed.count()).select("node", "component").distinct())
        pairs = pairs.unionByName(_through_rarest(members, _sets(members.select("node"), rows, sketches, shingle), marks, similarity)).distinct()
    apart = written(pairs.join(near, ["a", "b"], "left_anti"))
    rest = _verified(apart, rows, sketches, shingle, similarity)
    linked = components(first.unionByName(rest))
    dropped(placed, marks, near, mixed, apart, first, rest)
    return sketches.select("key", "th", "node").join(linked, "node", "left").select("key", "th", F.coalesce("component", "node").alias("component"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """docs without near-duplicates: one row of each group stays, that with its smallest id.

    Texts are lower-cased in A-Z; null, empty and blank ones are alike, and a text of fewer
    words than a shingle is one shingle. Texts are taken whole, however long. Rows that
    share the smallest id and the text are one document repeated, of which one stays, the
    same on every run. A row with a null id goes by a hash of its text, before all ids. All
    columns are kept, whatever their names; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(text), 2))
    rows = bounded(docs).select(whole_row(docs.columns), key.alias("key"), F.xxhash64(text).alias("th"), text.alias("text"))
    found = written(groups(rows.select("key", "th", "text"), shingle, similarity, crowd))
    first = found.groupBy("component").agg(F.min(F.struct("key", "th")).alias("k")).select("k.*")
    counts = found.groupBy("key", "th").agg(F.count("*").alias("n"))
    first = written(first.join(counts, ["key", "th"]))
    kept = rows.drop("text")
    single = kept.join(first.where("n = 1"), ["key", "th"], "left_semi").select("row")
    repeated = kept.join(first.where("n > 1"), ["key", "th"], "left_semi").groupBy("key", "th").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return single.unionByName(repeated).select("row.*")
