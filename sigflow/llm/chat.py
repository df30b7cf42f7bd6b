"""Repair of conversations: the cheapest edits that give ``(s?(ua)+)?`` as roles, by A* on the edit lattice."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sigflow.session import checkpoint, ship

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States of the role pattern: nothing yet, behind s, behind u, behind a. START and A may end a conversation.
START, S, U, A = range(4)
_NEXT = (U, U, A, U)
_NEW_ROLE = {U: "user", A: "assistant"}
#: What is missing behind each state at the end of a conversation.
_TAIL = ("", "II", "I", "")
#: Turns, and bytes of text, of one block at most. Longer conversations are blocks that are put together afterwards.
TURNS, BYTES = 512, 4 << 20
#: A turn's kind: role initial (x if no role starts with it), upper case if truncated, - if it must be deleted.
_GONE = "-"


def _keeps(state: int, initial: str) -> int | None:
    """State behind a kept turn, None if the pattern forbids it."""
    if initial == "s":
        return S if state == START else None
    return _NEXT[state] if initial == ("u", "u", "a", "u")[state] else None


@lru_cache(1 << 14)
def search(kinds: str, entry: int, whole: bool) -> tuple[tuple[int, int, str], ...]:
    """(state at the end, cost, edits) of the cheapest edits of some turns for a pattern that is in state ``entry``.

    A* on nodes (turns consumed, state). The heuristic is a suffix sum: 4 for each
    turn that must be deleted, 3 for each truncated one, which costs that much if it
    stays and more if it goes. It never exceeds what is to come and falls by no more
    than a step costs, so a node is final when it is first taken off the heap; the
    key (cost plus heuristic, edits) makes that the ASCII-least of the cheapest.
    No two edit strings to one node have the same cost with one the other's
    beginning, so the least whole string begins with the least part.

    A whole conversation ends where the pattern may end, and one result is given. For a
    block, insertions belong before a turn of it, and each end state gives one.
    """
    n = len(kinds)
    left = [0] * (n + 1)
    for k in range(n - 1, -1, -1):
        left[k] = left[k + 1] + (DELETE if kinds[k] == _GONE else TRUNCATED if kinds[k].isupper() else 0)
    heap = [(left[0], "", 0, entry)]
    done: set[tuple[int, int]] = set()
    out = []
    while heap:
        f, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and (not whole or state in (START, A)):
            out.append((state, f, audit))
            if whole or len(out) == 4:
                break
            continue
        if i < n:
            cost = f - left[i]
            kind = kinds[i]
            rest = left[i + 1]
            heapq.heappush(heap, (cost + DELETE + rest, audit + "D", i + 1, state))
            if kind != _GONE:
                cost += TRUNCATED if kind.isupper() else 0
                to = _keeps(state, kind.lower())
                if to is not None:
                    heapq.heappush(heap, (cost + KEEP + rest, audit + "K", i + 1, to))
                heapq.heappush(heap, (cost + REROLE + rest, audit + "R", i + 1, _NEXT[state]))
        if i < n or whole:
            heapq.heappush(heap, (f + INSERT, audit + "I", i, _NEXT[state]))
    return tuple(out)


def apply_edits(audit: str, entry: int, turns: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The turns that the edits leave, inserted ones with empty text."""
    out, state, k = [], entry, 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else turns[k]
        k += edit != "I"
        if edit == "D":
            continue
        state = _keeps(state, role[:1]) if edit == "K" else _NEXT[state]
        out.append((role if edit == "K" else _NEW_ROLE[state], text))
    return out


@dataclass
class _Block:
    """Turns of one conversation that follow each other, and what is counted of them."""

    conv: int | None
    seq: int

    def __post_init__(self):
        self.turns: list[tuple[str, str]] = []
        self.kinds: list[str] = []
        self.size = self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.first_turn = self.last_turn = None
        self.last_key = None

    def add(self, turn, role, text, blank, cut, before) -> None:
        again = before or (turn, role, text) == self.last_key
        kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
        if blank:
            self.blank += 1
            kind = _GONE
        elif again:
            self.duplicate += 1
            kind = _GONE
        elif cut:
            self.truncated += 1
            kind = kind.upper()
        if self.turns:
            self.illegal += legal(self.turns[-1][0], role)
            self.distinct += turn is not None and turn != self.last_turn
        else:
            self.first_turn = turn
            self.distinct = int(turn is not None)
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.last_turn, self.last_key = turn, (turn, role, text)
        self.turns.append((role, text))
        self.kinds.append(kind)
        self.size += len(text)

    def full(self) -> bool:
        return len(self.turns) >= TURNS or self.size >= BYTES


def legal(role: str, following: str) -> int:
    """1 if two roles may not follow each other."""
    return int(role[:1] + following[:1] not in ("su", "ua", "au"))


_EDGE = "first_turn long, last_turn long, first_role string, last_role string"
_COUNTS = "blank long, duplicate long, truncated long, illegal long, low long, high long, distinct long"
_PATH = "array<struct<entry: int, state: int, cost: long, audit: string>>"
_TURNS = "array<struct<role: string, text: string>>"
_SCHEMA = f"conv_id long, part int, seq int, whole boolean, {_COUNTS}, {_EDGE}, paths {_PATH}, turns {_TURNS}"


def _row(b: _Block, part: int, whole: bool, starts: bool) -> dict:
    kinds = "".join(b.kinds)
    entries = (START,) if starts else range(4)
    paths = [{"entry": e, "state": s, "cost": c, "audit": a} for e in entries for s, c, a in search(kinds, e, whole)]
    role = [b.turns[k][0] if b.turns else None for k in (0, -1)]
    return {
        "conv_id": b.conv, "part": part, "seq": b.seq, "whole": whole, "blank": b.blank, "duplicate": b.duplicate, "truncated": b.truncated, "illegal": b.illegal, "low": b.low, "high": b.high, "distinct": b.distinct,
        "first_turn": b.first_turn, "last_turn": b.last_turn, "first_role": role[0], "last_role": role[1], "paths": paths, "turns": [{"role": r, "text": t} for r, t in b.turns],
    }


def _blocks(schema: pa.Schema):
    """Blocks of sorted turns. A conversation inside one block and one partition is solved at once.

    The first and the last conversation of a partition may go on in others, and one
    beyond a block goes on in the next; of those each block is solved for every
    state in which the pattern may be there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rows, size, held = [], 0, None
        opened = True  # this conversation may have begun in an earlier partition
        for b in batches:
            for conv, turn, role, text, gone, blank, cut, before in zip(*(c.to_pylist() for c in b.columns)):
                if held is None:
                    held = _Block(conv, 0)
                elif held.conv != conv or held.full():
                    ends, starts = held.conv != conv, not opened and held.seq == 0
                    rows.append(_row(held, part, ends and starts, starts))
                    size += held.size
                    after, held = held, _Block(conv, 0 if ends else held.seq + 1)
                    held.last_key = None if ends else after.last_key
                    opened &= not ends
                if not gone:
                    held.add(turn, role, text, blank, cut, before)
                if len(rows) >= 256 or size >= BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if held is not None:
            rows.append(_row(held, part, False, not opened and held.seq == 0))
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


class _Chain:
    """The cheapest way through a conversation's blocks, block by block.

    Kept for each state: cost, and the place of its edits among those of the other
    states. Block by block an end state takes the least (cost, place, edits of the
    block); back pointers name the entry state that it came from.
    """

    def __init__(self, conv):
        self.conv = conv
        self.label = {START: (0, 0)}
        self.back: list[tuple] = []
        self.count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "distinct"), 0)
        self.low = self.high = self.last_turn = self.last_role = None

    def add(self, r: dict) -> None:
        best: dict[int, tuple] = {}
        for p in r["paths"]:
            if p["entry"] in self.label:
                cost, place = self.label[p["entry"]]
                got = (cost + p["cost"], place, p["audit"], p["entry"])
                if p["state"] not in best or got < best[p["state"]]:
                    best[p["state"]] = got
        order = sorted(best, key=lambda s: best[s][1:3])
        self.label = {s: (best[s][0], k) for k, s in enumerate(order)}
        self.back.append((r["part"], r["seq"], {s: best[s][3] for s in best}))
        for k in self.count:
            self.count[k] += r[k]
        if r["first_role"] is not None:
            if self.last_role is not None:
                self.count["illegal"] += legal(self.last_role, r["first_role"])
                self.count["distinct"] -= r["first_turn"] is not None and r["first_turn"] == self.last_turn
            self.last_role, self.last_turn = r["last_role"], r["last_turn"]
        if r["low"] is not None:
            self.low = r["low"] if self.low is None else self.low
            self.high = r["high"]

    def rows(self) -> Iterator[dict]:
        """Entry and end state of each block; the last block has the conversation's counts too."""
        state = min(self.label, key=lambda s: (self.label[s][0] + INSERT * len(_TAIL[s]), self.label[s][1]))
        cost = self.label[state][0] + INSERT * len(_TAIL[state])
        end = {**self.count, "low": self.low, "high": self.high, "cost": cost, "tail": _TAIL[state]}
        for k in range(len(self.back) - 1, -1, -1):
            part, seq, came = self.back[k]
            yield {"conv_id": self.conv, "part": part, "seq": seq, "entry": came[state], "state": state, **end}
            state, end = came[state], {}


_WAY = "conv_id long, part int, seq int, entry int, state int, blank long, duplicate long, truncated long, illegal long, distinct long, low long, high long, cost long, tail string"


def _chains(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, rows = None, []
        for b in batches:
            for r in b.to_pylist():
                if chain is None or chain.conv != r["conv_id"]:
                    rows += chain.rows() if chain else ()
                    chain = _Chain(r["conv_id"])
                chain.add(r)
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
        rows += chain.rows() if chain else ()
        yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def turn_flags(text: Column) -> tuple[Column, Column]:
    """Whether a text has nothing but blanks, and whether its last other character ends no sentence."""
    bare = F.rtrim(text, F.lit("\t\n\x0b\f\r "))
    return bare == "", ~F.right(bare, F.lit(1)).isin(".", "!", "?")


def _sorted_turns(rows: DataFrame, gone: str | None) -> DataFrame:
    """All turns with their flags, in the order of conversation and turn over the partitions.

    A repeated (role, text) of a conversation is found by its 128-bit hash and the first
    turn that has it; copies within one turn lie side by side once sorted. The range
    of a partition cuts through a long conversation.
    """
    blank, cut = turn_flags(F.col("text"))
    base = rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        (F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)).alias("gone"),
    ).select("*", blank.alias("blank"), cut.alias("cut"), F.xxhash64("role", "text").alias("d1"), F.xxhash64(F.lit(1), "text", "role").alias("d2"))
    met = base.where("not gone and not blank").groupBy("conv_id", "d1", "d2").agg(F.min("turn").alias("since"), F.max("turn").alias("till"), (F.count("turn") < F.count("*")).alias("untimed"))
    met = met.where("since < till or (untimed and since is not null)").select(F.col("conv_id").alias("c"), F.col("d1").alias("e1"), F.col("d2").alias("e2"), "since", "untimed")
    same = base["conv_id"].eqNullSafe(met["c"]) & (base["d1"] == met["e1"]) & (base["d2"] == met["e2"])
    before = F.col("since").isNotNull() & F.col("turn").isNotNull() & (F.col("untimed") | (F.col("turn") > F.col("since")))
    flagged = base.join(met, same, "left").select("conv_id", "turn", "role", "text", "gone", "blank", "cut", F.coalesce(before, F.lit(False)).alias("before"))
    place = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role")]
    return flagged.repartitionByRange(*place, F.substring("text", 1, 32)).sortWithinPartitions(*place, "text")


def _solve(rows: DataFrame, gone: str | None) -> tuple[DataFrame, DataFrame]:
    """Blocks, and the way through each block of the conversations that are more than one."""
    ship(rows.sparkSession)
    blocks = checkpoint(_sorted_turns(rows, gone).mapInArrow(_blocks(to_arrow_schema(T.StructType.fromDDL(_SCHEMA))), _SCHEMA))
    parts = blocks.where("not whole").drop("turns", "whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return blocks, checkpoint(parts.mapInArrow(_chains(to_arrow_schema(T.StructType.fromDDL(_WAY))), _WAY))


_EDITS = "conv_id long, part int, seq int, audit string, turns array<struct<role: string, text: string>>, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, tail boolean"


def _edited(blocks: DataFrame, way: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each block with its audit and the turns that are left; the last one of a conversation has ``tail`` and all counts. First the blocks that are a whole conversation, then the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("turns")
            left = [[{"role": r, "text": t} for r, t in apply_edits(a, e, [(x["role"], x["text"]) for x in turns])] for a, e, turns in zip(b.column("audit").to_pylist(), b.column("entry").to_pylist(), b.column("turns").to_pylist())]
            yield b.set_column(at, b.schema.field(at), pa.array(left, b.schema.field(at).type)).drop_columns(["entry"])

    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0)).alias("gaps")
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    alone = blocks.where("whole").withColumn("cost", F.col("paths")[0]["cost"]).select("conv_id", "part", "seq", F.col("paths")[0]["audit"].alias("audit"), "turns", gaps, *counts, F.lit(True).alias("tail"), F.lit(START).alias("entry"))
    of = way.select(F.struct(*way.columns).alias("w"))
    met = blocks.where("not whole").select("conv_id", "part", "seq", "paths", "turns").join(of, F.col("conv_id").eqNullSafe(F.col("w.conv_id")) & (F.col("part") == F.col("w.part")) & (F.col("seq") == F.col("w.seq")))
    path = F.filter("paths", lambda p: (p["entry"] == F.col("w.entry")) & (p["state"] == F.col("w.state")))[0]["audit"]
    joined = met.select("conv_id", "part", "seq", F.concat(path, F.coalesce("w.tail", F.lit(""))).alias("audit"), "turns", "w.entry", *(F.col(f"w.{c}") for c in ("high", "low", "distinct", *counts, "tail")))
    chained = joined.select("conv_id", "part", "seq", "audit", "turns", gaps, *counts, F.col("tail").isNotNull().alias("tail"), "entry")
    return alone.mapInArrow(run, _EDITS), chained.mapInArrow(run, _EDITS)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation; the text of a long one goes by block by block."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    types = [pa.string() if n in ("audit", "repaired_sha256") else pa.int64() for n in names]
    audit, sha, empty = [], hashlib.sha256(), True
    for b in batches:
        out = []
        for r in b.to_pylist():
            audit.append(r["audit"])
            for t in r["turns"]:
                sha.update(f"{'' if empty else chr(10)}{t['role']}:{t['text']}".encode())
                empty = False
            if r["tail"]:
                out.append([*(r[n] for n in names[:7]), "".join(audit), sha.hexdigest()])
                audit, sha, empty = [], hashlib.sha256(), True
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def repair_conversations(rows: DataFrame, *, gone: str | None = None) -> DataFrame:
    """One row a conversation: its faults, the cheapest edits and a digest of what they leave.

    ``rows`` has conv_id, turn, role and text; rows with a true ``gone`` column are not
    there but name their conversation. Turns are taken by turn (nulls first), then
    role and text. Faults: blank text, role and text seen earlier, last character no
    end of a sentence; a row counts for its first. Edits: Keep 0, Rerole to user or
    assistant 3, Delete 4 (required for blank and repeated rows), Insert an empty user
    or assistant turn 3; a truncated row that stays adds 3. The result's role initials
    match ``(s?(ua)+)?``; ``audit`` has the edits' initials, ASCII-least of the cheapest.

    A null role or text is one space. An empty role fits no place. Rows with a null
    conv_id are one conversation. A conversation without rows has zeros, an empty audit
    and the digest of nothing. Repeated rows are duplicates. A conversation may have any
    number of turns: sorted ranges cut it, blocks of 512 turns are solved for every
    state before them, and only their costs meet; texts may be of any length. An
    empty table gives an empty result; other columns are not looked at.
    """
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    alone, chained = _edited(*_solve(rows, gone))
    ordered = chained.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return alone.mapInArrow(_digest, schema).union(ordered.mapInArrow(_digest, schema))


def repaired_turns(rows: DataFrame, *, gone: str | None = None) -> DataFrame:
    """The turns that the edits leave: (conv_id, part, seq, turn, role, text), in the order of part, seq and turn."""
    alone, chained = _edited(*_solve(rows, gone))
    return alone.union(chained).select("conv_id", "part", "seq", F.posexplode("turns").alias("turn", "t")).select("conv_id", "part", "seq", "turn", "t.role", "t.text")


def damage(rows: DataFrame) -> DataFrame:
    """Rows with planted faults by crc32 of ``conv_id:turn`` modulo 20: 0 gone, 1 emptied, 2 without ends of sentences, 3 repeated, 4 said by the user."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(name("text"), ".!?", "")).otherwise(name("text"))
    role = F.when(fault == 4, "user").otherwise(name("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (fault == 0).alias("gone"), F.explode(F.array_repeat(F.lit(1), F.when(fault == 3, 2).otherwise(1))).alias("copy")).drop("copy")
