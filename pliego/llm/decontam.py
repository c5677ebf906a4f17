"""Operator 8: benchmark decontamination by pigeonhole edit matching.

A test item of m characters may be found with k = floor(rate x m) edits. It is cut into
k + 1 pieces; k edits spoil at most k of them, so one piece stands unchanged in any match.
An automaton over all pieces finds their exact hits in a document in one pass; each hit
gives a stretch of text in which Myers' bit-parallel distance looks for the item. Texts and
items are compared in lower case with runs of white space as one space.

The pieces go to every task only while the items are within ITEMS_AT_ONCE characters;
larger benchmarks are taken in blocks of that size, one scan of the documents for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded, mapped_whole

RATE = 0.075
#: Characters of items that one task holds; their automaton takes about 70 bytes for each.
ITEMS_AT_ONCE = 2 << 20


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): the item cut into budget + 1 pieces of nearly equal length."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def best_match(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(distance, end) of the substring of text nearest to the pattern, the first such end.

    masks holds for each character the bits of the places where the pattern has it.
    """
    every, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = every, 0, m, m, 0
    get = masks.get
    for i, c in enumerate(text, 1):
        eq = get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (every & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, end = score, i
        up, down = (up << 1) & every, (down << 1) & every
        plus, minus = down | (every & ~(vertical | up)), up & vertical
    return best, end


class Matcher:
    """Finds items in texts; items are (id, text) pairs."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.items = []
        found: dict[str, list[tuple[int, int]]] = {}
        for ident, text in items:
            text = normal(text)
            if not text:
                continue
            budget = int(rate * len(text))
            masks: dict[str, int] = {}
            for i, c in enumerate(text):
                masks[c] = masks.get(c, 0) | 1 << i
            for offset, piece in pieces(text, budget):
                found.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((ident, text, budget, masks))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if found:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, distance, end in the normalised text) of each item that the text holds."""
        if not self.items:
            return []
        text = normal(text)
        stretches: dict[int, list[list[int]]] = {}
        for at, (size, uses) in self.automaton.iter(text):
            for n, offset in uses:
                _, item, budget, _ = self.items[n]
                lo = at + 1 - size - offset - budget
                hi = lo + len(item) + 2 * budget
                own = stretches.setdefault(n, [])
                if own and own[-1][0] <= lo <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], hi)
                else:
                    own.append([lo, hi])
        out = []
        for n, own in stretches.items():
            ident, item, budget, masks = self.items[n]
            best = (budget + 1, 0)
            for lo, hi in own:
                lo = max(lo, 0)
                at = text.find(item, lo, hi)
                found = (0, at + len(item)) if at >= 0 else None
                if not found:
                    distance, end = best_match(masks, len(item), text[lo:hi])
                    found = distance, lo + end
                best = min(best, found)
            if best[0] <= budget:
                out.append((ident, *best))
        return out


def item_blocks(benchmark: DataFrame, at_once: int = ITEMS_AT_ONCE) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about at_once characters; one block is on the driver at a time."""
    items = benchmark.where("text is not null").select("item_id", "text").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = total // at_once + 1
    for block in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        yield [tuple(r) for r in own.orderBy("item_id", "text").collect()]


def _match_rows(items: list[tuple[int, str]], rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, rate)
        for batch in batches:
            row, out = [], [[], [], []]
            for i, text in enumerate(batch.column("text").to_pylist()):
                for found in matcher.find(text):
                    row.append(i)
                    for x, value in zip(out, found):
                        x.append(value)
            types = (pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, t) for x, t in zip(out, types))], ["doc_id", "item_id", "distance", "match_end"])

    return run


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, at_once: int = ITEMS_AT_ONCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, match_end): each row of docs with each item it holds.

    distance is the least number of edits, match_end where that match first ends in the
    normalised text. Null and empty texts hold nothing; null and empty items are never
    held; items of one id with different texts are separate items; repeated rows of docs
    each give their rows, repeated rows of the benchmark count once; null ids stay null.
    An empty table on either side gives an empty result. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    schema = "doc_id long, item_id long, distance int, match_end long"
    found = None
    for items in item_blocks(benchmark, at_once):
        own = rows.mapInArrow(_match_rows(items, rate), schema)
        found = own if found is None else found.unionByName(own)
    return found


def _clean_rows(items: list[tuple[int, str]], rate: float, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, rate)
        for batch in batches:
            clean = [not t or not matcher.find(str(t)) for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, at_once: int = ITEMS_AT_ONCE, text_col: str = "text") -> DataFrame:
    """docs without the rows that hold an item; all columns are kept, whatever their names.

    Rows with a null or empty text hold nothing and stay, as do all rows if the benchmark has
    no items; repeated rows go or stay together. An empty table stays empty.
    """
    place = docs.columns.index(text_col)
    for items in item_blocks(benchmark, at_once):
        docs = mapped_whole(bounded(docs), _clean_rows(items, rate, place))
    return docs
