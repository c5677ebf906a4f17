"""Operator 12: conversations repaired at least cost, by a bidirectional graph of tight arcs.

A repaired conversation's role initials read ``(s?(ua)+)?``. Turns are kept, given another
role, deleted, or preceded by an inserted empty one; the cheapest edits are wanted and, among
equally cheap ones, those whose letters come first. Nodes of the graph are (turn, state of
the pattern), arcs are edits. Minimum costs from the beginning and to the end tell the arcs
of all cheapest edits, the tight ones: cost before + arc + cost after = the whole. From the
first node a frontier of states follows, at each step, the tight arcs of the least letter.

No task gets the turns of a long conversation. Turns are sorted over range partitions
and cut into blocks; a block's least costs from each state to each are a small matrix, the
matrices of a conversation give the costs at the ends of its blocks, each block walks its
tight arcs from every state it can be entered in, and the walks are chained.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded, written

#: A block holds the turns whose places agree but for so many low bits.
BLOCK_BITS = 12
#: Costs of the edits, and of leaving a truncated turn in.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

#: States: nothing yet; after the system turn; after a user turn; after an assistant turn.
_STATES = 4
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The one role besides system that a state goes on with, and the state then.
_GOES_ON = {p: (q, {"u": "user", "a": "assistant"}[c]) for (p, c), q in _NEXT.items() if c != "s"}
#: Cost to end the conversation in a state, by inserted turns.
_END = (0, 2 * INSERT, INSERT, 0)
_FAR = 1 << 60

#: A turn's kind is its role initial (x: another) and its fault: kept as it is, truncated, or to be deleted.
_SOUND, _CUT, _GONE = 0, 1, 2


def _arcs(state: int, initial: str, fault: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of a turn in a state."""
    found = [("D", DELETE, state)]
    if fault != _GONE:
        left_in = TRUNCATED * (fault == _CUT)
        if (state, initial) in _NEXT:
            found.append(("K", left_in, _NEXT[state, initial]))
        found.append(("R", REROLE + left_in, _GOES_ON[state][0]))
    return found


def _closure() -> np.ndarray:
    """Least cost of insertions from state to state."""
    cost = np.full((_STATES, _STATES), _FAR)
    for p in range(_STATES):
        q, spent = p, 0
        while spent < cost[p, q]:
            cost[p, q] = spent
            q, spent = _GOES_ON[q][0], spent + INSERT
    return cost


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of cost matrices: least sums instead of sums of products."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(axis=-2), _FAR)


def _steps() -> dict[tuple[str, int], np.ndarray]:
    """For each kind of turn, the least cost from state to state of insertions and then its edit."""
    found = {}
    for initial in "suax":
        for fault in (_SOUND, _CUT, _GONE):
            row = np.full((_STATES, _STATES), _FAR)
            for p in range(_STATES):
                for _, cost, q in _arcs(p, initial, fault):
                    row[p, q] = min(row[p, q], cost)
            found[initial, fault] = _times(_closure(), row)
    return found


_STEP = _steps()


def walk(turns: list[tuple[str, int, int]], state: int, spent: int, whole: int, behind: list[int], last: bool) -> tuple[int, str] | None:
    """The tight arcs of least letters through a block's turns (initial, fault, copies).

    The block is entered in a state at the cost ``spent`` from the beginning; ``behind`` are
    the costs from its end to the conversation's, ``whole`` is the least cost of all. Gives
    the state behind the block and the letters; None if no cheapest edit enters in this state.
    Copies of a turn beyond the first are deleted at once. Insertions stand before the turn
    that needs them, or at the end: a deletion's letter is less than theirs.
    """
    to_end = [np.array(behind)]
    for turn in reversed(turns):
        to_end.append((_STEP[turn[:2]] + to_end[-1]).min(axis=1))
    to_end.reverse()
    if spent + to_end[0][state] != whole:
        return None
    frontier, letters, i = {state}, [], 0
    while i < len(turns) or last and any(to_end[i][s] for s in frontier):
        tight = []
        for s in frontier:
            arcs = [("I", INSERT, _GOES_ON[s][0], i)]
            if i < len(turns):
                arcs += [(letter, cost, to, i + 1) for letter, cost, to in _arcs(s, *turns[i][:2])]
            tight += [arc for arc in arcs if spent + arc[1] + to_end[arc[3]][arc[2]] == whole]
        letter = min(arc[0] for arc in tight)
        chosen = [arc for arc in tight if arc[0] == letter]
        frontier, spent = {arc[2] for arc in chosen}, spent + chosen[0][1]
        letters.append(letter)
        if letter != "I":
            letters.append("D" * (turns[i][2] - 1))
            i += 1
    (state,) = frontier  # a letter leads from a state to one state only
    return state, "".join(letters)


def replay(turns: list[tuple[str, int, int]], state: int, letters: str) -> Iterator[tuple[list[str], str, str | None]]:
    """(roles inserted before, letter, role given) of each turn; then, with the letter "", the roles inserted behind all."""
    inserted: list[str] = []
    turn, at = iter(turns), 0
    while at < len(letters):
        letter = letters[at]
        at += 1
        to, role = _GOES_ON[state]
        if letter == "I":
            inserted.append(role)
            state = to
            continue
        initial, _, copies = next(turn)
        at += copies - 1
        yield inserted, letter, role if letter == "R" else None
        inserted = []
        state = state if letter == "D" else to if letter == "R" else _NEXT[state, initial]
    yield inserted, "", None


# --- turns in order --------------------------------------------------------------------------

_KEY = ["conv", "conv_null"]


def placed(turns: DataFrame, bits: int = BLOCK_BITS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for all equal turns: (conv, conv_null, turn, role, text, n, place, block, initial, blank, cut), written.

    place rises with conversation, turn (nulls first), role and digest of the text. A null
    role or text is one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    conv, turn, role, text = F.col(conv_col).cast("long"), F.col(turn_col).cast("long"), space(role_col), space(text_col)
    rows = bounded(turns).select(F.coalesce(conv, F.lit(0)).alias("conv"), conv.isNull().alias("conv_null"), turn.alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.groupBy(*_KEY, "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("digest", F.md5(F.col("text").cast("binary")))
    order = [*_KEY, F.asc_nulls_first("turn"), "role", "digest"]
    end = F.right(F.rtrim("text", F.lit("\x20\x09\x0a\x0b\x0c\x0d")), F.lit(1))
    first = F.substring("role", 1, 1)
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    return written(
        rows.select(
            *_KEY, "turn", "role", "text", "n", "digest", "place", F.shiftright("place", bits).alias("block"),
            F.when(first.isin("s", "u", "a"), first).otherwise("x").alias("initial"), (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut"),
        )
    )


def faulted(rows: DataFrame) -> DataFrame:
    """placed rows without texts, with ``first``: no earlier turn of the conversation has their role and text."""
    slim = rows.drop("text")
    firsts = slim.where("NOT blank").groupBy(*_KEY, "role", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    return slim.join(firsts, "place", "left").withColumn("first", F.coalesce("first", F.lit(False)))


def _blocks(flagged: DataFrame) -> DataFrame:
    """(conv, conv_null, block, places, initials, faults, copies), one row for each block, its turns in order."""
    fault = F.when(F.col("blank") | ~F.col("first"), _GONE).when(F.col("cut"), _CUT).otherwise(_SOUND)
    turn = F.struct("place", "initial", fault.cast("int").alias("fault"), "n")
    rows = flagged.groupBy(*_KEY, "block").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    names = {"places": "place", "initials": "initial", "faults": "fault", "copies": "n"}
    return written(rows.select(*_KEY, "block", *(F.col(f"turns.{f}").alias(c) for c, f in names.items())))


_KEY_FIELDS = [("conv", pa.int64()), ("conv_null", pa.bool_())]
_ROLES = pa.list_(pa.string())


def _mapped(df: DataFrame, f: Callable[[dict], list[dict]], fields: list[tuple[str, pa.DataType]], ddl: str, most: int = 1000) -> DataFrame:
    """The rows that f makes of each row, with the row's conversation."""
    schema = pa.schema(_KEY_FIELDS + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                held += [{"conv": row["conv"], "conv_null": row["conv_null"]} | out for out in f(row)]
                if len(held) >= most:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return df.mapInArrow(run, f"conv long, conv_null boolean, {ddl}")


def _turns(row: dict) -> list[tuple[str, int, int]]:
    return list(zip(row["initials"], row["faults"], row["copies"]))


def _summed(row: dict) -> list[dict]:
    """A block's matrix, its illegal neighbours, its end initials and the cost of its copies."""
    turns, initials = _turns(row), row["initials"]
    matrix = np.where(np.eye(_STATES, dtype=bool), 0, _FAR)
    for turn in turns:
        matrix = _times(matrix, _STEP[turn[:2]])
    copies = sum(n - 1 for *_, n in turns)
    illegal = copies + sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))
    return [{"block": row["block"], "matrix": matrix.ravel().tolist(), "illegal": illegal, "spare": DELETE * copies, "ends": [initials[0], initials[-1]]}]


_LEGAL = ("su", "ua", "au")


def _limits(row: dict) -> list[dict]:
    """From the matrices of a conversation's blocks, the costs before and behind each of them."""
    blocks = row["blocks"]
    matrices = [np.array(b["matrix"], np.int64).reshape(_STATES, _STATES) for b in blocks]
    before, behind = [np.array([0] + [_FAR] * (_STATES - 1))], [np.array(_END)]
    for m in matrices:
        before.append(np.minimum((before[-1][:, None] + m).min(axis=0), _FAR))
    for m in reversed(matrices):
        behind.append(np.minimum((m + behind[-1]).min(axis=1), _FAR))
    behind.reverse()
    whole = int(behind[0][0])
    seams = sum(a["ends"][1] + b["ends"][0] not in _LEGAL for a, b in zip(blocks, blocks[1:]))
    same = {"whole": whole, "cost": whole + sum(b["spare"] for b in blocks), "illegal": seams + sum(b["illegal"] for b in blocks)}
    return [
        same | {"block": b["block"], "before": before[k].tolist(), "behind": behind[k + 1].tolist(), "last": k + 1 == len(blocks)}
        for k, b in enumerate(blocks)
    ]


def _walked(row: dict) -> list[dict]:
    """The walks through a block from each state that a cheapest edit enters it in."""
    found = ((s, walk(_turns(row), s, row["before"][s], row["whole"], row["behind"], row["last"])) for s in range(_STATES))
    walks = [{"state": s, "to": w[0], "letters": w[1]} for s, w in found if w]
    return [{"block": row["block"], "cost": row["cost"], "illegal": row["illegal"], "walks": walks}]


def _chained(row: dict) -> list[dict]:
    """One walk a block, each entered in the state in which the one before ends."""
    state, path = 0, []
    for b in row["blocks"]:
        taken = next(w for w in b["walks"] if w["state"] == state)
        path.append({"block": b["block"], "state": state, "letters": taken["letters"]})
        state = taken["to"]
    return [{"cost": row["blocks"][0]["cost"], "illegal": row["blocks"][0]["illegal"], "path": path}]


def _edited(row: dict) -> list[dict]:
    """The edit of each turn of a block."""
    steps = list(replay(_turns(row), row["state"], row["letters"]))
    last = len(steps) - 2
    return [
        {"place": row["places"][i], "before": before, "letter": letter, "given": given, "behind": steps[-1][0] if i == last else []}
        for i, (before, letter, given) in enumerate(steps[:-1])
    ]


def _by_conversation(blocks: DataFrame, *columns: str) -> DataFrame:
    return blocks.groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("block", *columns))).alias("blocks"))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, joined by line breaks; lines come in order."""
    names, key, state = ["conv", "conv_null", "repaired_sha256"], None, None
    for batch in batches:
        done = []
        for at, line in zip(zip(*(batch.column(c).to_pylist() for c in ("conv", "conv_null"))), batch.column("line")):
            if at != key:
                done += [(*key, state.hexdigest())] if key else []
                key, state = at, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(line.as_py().encode("utf-8", "surrogatepass"))
        if done:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*done))), names)
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], names)


class Repair(NamedTuple):
    """paths: (conv, conv_null, cost, illegal, path), one row for each conversation; path has
    the letters of each block. faults: its counts. lines: the repaired turns (conv,
    conv_null, place, part, role, text, letter), in order of place and part."""

    paths: DataFrame
    faults: DataFrame
    lines: DataFrame


def repair(turns: DataFrame, bits: int = BLOCK_BITS, **columns) -> Repair:
    """The cheapest repair of every conversation, as tables.

    Turns go by number, nulls first; turns of one number by role and then by the MD5 of the
    text. A null role or text is one space, so it is another role, or blank. A null
    conversation id is a conversation. A turn that is equal to an earlier one in role and text
    is a duplicate, however often it occurs; equal rows are counted before anything else, so a
    row repeated without end is one row here. A role whose initial is none of s, u and a can't
    be kept; the empty role neither. No turns give no rows. Other columns are not read.
    """
    rows = placed(turns, bits, **columns)
    flagged = faulted(rows)
    blocks = _blocks(flagged)
    sums = _mapped(blocks, _summed, [("block", pa.int64()), ("matrix", pa.list_(pa.int64())), ("illegal", pa.int64()), ("spare", pa.int64()), ("ends", _ROLES)], "block long, matrix array<long>, illegal long, spare long, ends array<string>")
    limits = _mapped(
        _by_conversation(sums, "matrix", "illegal", "spare", "ends"), _limits,
        [("whole", pa.int64()), ("cost", pa.int64()), ("illegal", pa.int64()), ("block", pa.int64()), ("before", pa.list_(pa.int64())), ("behind", pa.list_(pa.int64())), ("last", pa.bool_())],
        "whole long, cost long, illegal long, block long, before array<long>, behind array<long>, last boolean",
    )
    walks_type = pa.list_(pa.struct([("state", pa.int32()), ("to", pa.int32()), ("letters", pa.string())]))
    walks = _mapped(blocks.join(limits, [*_KEY, "block"]), _walked, [("block", pa.int64()), ("cost", pa.int64()), ("illegal", pa.int64()), ("walks", walks_type)], "block long, cost long, illegal long, walks array<struct<state:int,to:int,letters:string>>")
    path_type = pa.list_(pa.struct([("block", pa.int64()), ("state", pa.int32()), ("letters", pa.string())]))
    paths = written(_mapped(_by_conversation(walks, "cost", "illegal", "walks"), _chained, [("cost", pa.int64()), ("illegal", pa.int64()), ("path", path_type)], "cost long, illegal long, path array<struct<block:long,state:int,letters:string>>"))
    chosen = paths.select(*_KEY, F.explode("path").alias("p")).select(*_KEY, "p.*")
    edits = _mapped(
        blocks.join(chosen, [*_KEY, "block"]), _edited,
        [("place", pa.int64()), ("before", _ROLES), ("letter", pa.string()), ("given", pa.string()), ("behind", _ROLES)], "place long, before array<string>, letter string, given string, behind array<string>",
    ).drop(*_KEY)
    line = lambda role, text, letter: F.struct(role.alias("role"), text.alias("text"), letter.alias("letter"))
    empty = lambda roles: F.transform(roles, lambda r: line(r, F.lit(""), F.lit("I")))
    own = F.filter(F.array(line(F.coalesce("given", "role"), F.col("text"), F.col("letter"))), lambda x: x["letter"] != "D")
    parts = F.posexplode(F.concat(empty(F.col("before")), own, empty(F.col("behind")))).alias("part", "line")
    lines = rows.join(edits, "place").select(*_KEY, "place", parts).select(*_KEY, "place", "part", "line.*")
    n, first = F.col("n"), F.col("first").cast("long")
    faults = flagged.groupBy(*_KEY).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"),
        F.sum(F.when(F.col("blank"), n).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(n - first)).alias("duplicate"),
        F.count_if(F.col("first") & F.col("cut")).alias("truncated"),
    )
    return Repair(paths, faults, lines)


def audited(conversations: DataFrame, turns: DataFrame, conv_col: str = "conv_id", **options) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each id in ``conversations``, of the repair of ``turns``.

    A conversation without turns has zeros, an empty audit and the digest of nothing. A digest
    needs a conversation's lines one after another: they pass through one task as a sorted
    stream, of which it holds one batch. An audit is one value, of less than 2^31 letters.
    """
    found = repair(turns, conv_col=conv_col, **options)
    lines = found.lines.select(*_KEY, "place", "part", F.concat("role", F.lit(":"), "text").alias("line"))
    digests = lines.repartition(*_KEY).sortWithinPartitions(*_KEY, "place", "part").drop("place", "part").mapInArrow(_digested, "conv long, conv_null boolean, repaired_sha256 string")
    audits = found.paths.select(*_KEY, "cost", "illegal", F.array_join("path.letters", "").alias("audit"))
    ids = conversations.select(F.col(conv_col).cast("long").alias("conv_id")).distinct()
    ids = ids.withColumns({"conv": F.coalesce("conv_id", F.lit(0)), "conv_null": F.col("conv_id").isNull()})
    rows = ids.join(found.faults, _KEY, "left").join(audits, _KEY, "left").join(digests, _KEY, "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) with faults planted by a hash of ``conv_id:turn``: a twentieth each is dropped, emptied, loses its closing marks, comes twice, becomes the user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), code.alias("code")).where("code <> 0")
    kept = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), kept.alias("text"), copies.alias("copy")).drop("copy")


#: The query's rows for DuckDB: a recursion over turns that keeps the least cost and letters of each state.
ORACLE_SQL = r"""
WITH RECURSIVE
tab AS (SELECT list(list_reduce([i::BIGINT] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) g(i)),
k AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
c AS (SELECT k.*, xor(list_reduce([4294967295::BIGINT] || list_transform(range(length(name)), lambda i: ord(name[i::INT + 1])::BIGINT), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % 20 AS code FROM k, tab),
d AS (SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
             CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text, unnest(range(CASE code WHEN 3 THEN 2 ELSE 1 END)) FROM c WHERE code <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM d),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS mark,
             lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM o),
f AS (SELECT *, CASE WHEN mark = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN mark NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM s),
ins(p, q, cost, letters, lines) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (3, 2, 2, 'I', ['user:']),
  (2, 3, 2, 'I', ['assistant:']), (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])),
edit(q, letter, initial, nxt, given) AS (VALUES (0, 'K', 's', 1, NULL), (0, 'K', 'u', 2, NULL), (1, 'K', 'u', 2, NULL), (2, 'K', 'a', 3, NULL), (3, 'K', 'u', 2, NULL),
  (0, 'R', NULL, 2, 'user'), (1, 'R', NULL, 2, 'user'), (2, 'R', NULL, 3, 'assistant'), (3, 'R', NULL, 2, 'user'), (0, 'D', NULL, 0, NULL), (1, 'D', NULL, 1, NULL), (2, 'D', NULL, 2, NULL), (3, 'D', NULL, 3, NULL)),
path AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS st, {'cost': 0, 'letters': '', 'lines': []::VARCHAR[]} AS x FROM o
  UNION ALL
  SELECT conv_id, i, st, arg_min(x, lpad(x.cost::VARCHAR, 9, '0') || x.letters) FROM (
    SELECT f.conv_id, f.i, e.nxt AS st,
           {'cost': x.cost + ins.cost + CASE e.letter WHEN 'D' THEN 3 ELSE CASE e.letter WHEN 'R' THEN 2 ELSE 0 END + CASE fault WHEN 'truncated' THEN 1 ELSE 0 END END,
            'letters': x.letters || ins.letters || e.letter,
            'lines': x.lines || ins.lines || CASE e.letter WHEN 'D' THEN []::VARCHAR[] ELSE [coalesce(given, role) || ':' || text] END} AS x
    FROM path JOIN f ON f.conv_id IS NOT DISTINCT FROM path.conv_id AND f.i = path.i + 1 JOIN ins ON ins.p = path.st JOIN edit e ON e.q = ins.q
    WHERE e.letter = 'D' OR (fault IN ('', 'truncated') AND (e.letter = 'R' OR e.initial = left(role, 1)))) GROUP BY ALL),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1),
z AS (SELECT n.conv_id, arg_min({'cost': x.cost + ins.cost, 'letters': x.letters || ins.letters, 'lines': x.lines || ins.lines}, lpad((x.cost + ins.cost)::VARCHAR, 9, '0') || x.letters || ins.letters) AS x
      FROM n JOIN path ON path.conv_id IS NOT DISTINCT FROM n.conv_id AND path.i = n.n JOIN ins ON ins.p = path.st AND ins.q IN (0, 3) GROUP BY 1)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(x.cost, 0)::BIGINT AS cost, coalesce(x.letters, '') AS audit, sha256(coalesce(array_to_string(x.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id
"""
