"""Conversations with lost, broken and repeated turns, and their cheapest repair (operator 13)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Costs of the edits; a truncated turn that is not deleted costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Grammar (s?(ua)+)?: nothing yet, after s, after u, after a; the state that an initial leads to from each of these.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_TO = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
#: From each state the one role that may follow and is not system.
_ROLE = ("user", "user", "assistant", "user")
_AFTER = (USER, USER, ASSISTANT, USER)
#: From any state the rest of a conversation costs at most 12 more than from any other (two inserts and a delete), so a state that
#: costs more than this over the best is never the answer.
HOPELESS = 20
#: Letters of an audit in one piece, letters of a comparison key.
PIECE, KEY = 256, 64
BLANK = " \t\n\x0b\x0c\r"


def damage(rows: DataFrame) -> DataFrame:
    """The contract's damage of (conv_id, turn, role, text): null roles and texts are one space (as null ids are in the checksum).
    A dropped turn stays as a row with ``gone``, so that its conversation is not lost."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).cast("int").alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("k") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def _in_order(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone, first): each conversation in one partition, by turn (nulls first), role and text; ``first`` if
    no earlier row has role and text. One exchange: the window's keys hold the conversation's, and sorts spill."""
    gone = F.coalesce("gone", F.lit(False)) if "gone" in rows.columns else F.lit(False)
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("gone"))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    # two hashes of 64 bits tell texts apart
    same = Window.partitionBy("conv_id", "gone", F.xxhash64("role", "text"), F.xxhash64(F.lit(7), "text", "role")).orderBy(*order)
    marked = rows.repartition("conv_id").withColumn("first", F.row_number().over(same) == 1)
    return marked.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order)


def _fault(text: str, first: bool) -> str | None:
    bare = text.rstrip(BLANK)
    if not bare:
        return "blank"
    if not first:
        return "duplicate"
    return None if bare[-1] in ".!?" else "truncated"


class _Layer:
    """The four states after some turns: each the least (cost, audit), with the digest of what is repaired so far.

    An audit is kept in pieces, and compared by a short key that orders the four states' audits as the whole ones would: audits of
    one layer answer for the same turns, so of two, one is the other and some inserts, or they differ at a place and keep their
    order whatever follows. A conversation of any length thus takes linear time, and a byte a turn and state.
    """

    def __init__(self) -> None:
        self.states = [(0, "", None, "", hashlib.sha256()), None, None, None]
        self._insert()

    def _put(self, found: list, state: int, to: int, cost: int, letter: str, line: bytes | None) -> None:
        before = self.states[state]
        new = (before[0] + cost, before[1] + letter)
        if found[to] is None or new < found[to][:2]:
            found[to] = (*new, before, letter, line, state)

    @staticmethod
    def _made(chosen: tuple) -> tuple:
        cost, key, (_, _, pieces, tail, digest), letter, line, state = chosen
        tail += letter
        if len(tail) >= PIECE:
            pieces, tail = (pieces, tail), ""
        if line is not None:
            digest = digest.copy()
            digest.update(line if state == NOTHING else b"\n" + line)
        return cost, key, pieces, tail, digest

    def _insert(self) -> None:
        """At most two inserts are worth their cost between turns: user, then assistant."""
        for state in (NOTHING, SYSTEM, ASSISTANT, USER):
            if self.states[state] is not None:
                to, found = _AFTER[state], [None] * 4
                self._put(found, state, to, INSERT, "I", f"{_ROLE[state]}:".encode())
                if self.states[to] is None or found[to][:2] < self.states[to][:2]:
                    self.states[to] = self._made(found[to])

    def turn(self, role: str, text: str, fault: str | None) -> None:
        found: list = [None] * 4
        more = TRUNCATED if fault == "truncated" else 0
        keeps = _TO.get(role[:1], (None,) * 4)
        kept = f"{role}:{text}".encode()
        for state in range(4):
            if self.states[state] is None:
                continue
            self._put(found, state, state, DELETE, "D", None)
            if fault not in ("blank", "duplicate"):
                if keeps[state] is not None:
                    self._put(found, state, keeps[state], more, "K", kept)
                self._put(found, state, _AFTER[state], REROLE + more, "R", f"{_ROLE[state]}:{text}".encode())
        best = min(f[0] for f in found if f is not None)
        self.states = [None if f is None or f[0] > best + HOPELESS else self._made(f) for f in found]
        self._insert()
        if any(s is not None and len(s[1]) > KEY for s in self.states):
            self._shorten()

    def _shorten(self) -> None:
        names, base, rank = {}, None, 0
        for key in sorted({s[1] for s in self.states if s is not None}):
            if base is None or not key.startswith(base):
                base, rank = key, rank + 1
            names[key] = chr(rank) + key[len(base) :]
        self.states = [None if s is None else (s[0], names[s[1]], *s[2:]) for s in self.states]

    def result(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the best repair; it ends with nothing or after an assistant."""
        cost, _, pieces, tail, digest = min((s for s in (self.states[NOTHING], self.states[ASSISTANT]) if s is not None), key=lambda s: s[:2])
        parts = [tail]
        while pieces is not None:
            pieces, part = pieces
            parts.append(part)
        return cost, "".join(reversed(parts)), digest.hexdigest()


class _Repair:
    """What is counted of one conversation, turn by turn."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.layer, self.counts = conv_id, _Layer(), {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.least = self.last = self.role = None
        self.turns = 0

    def add(self, turn, role: str, text: str, first: bool) -> None:
        if turn is not None and turn != self.last:
            self.least, self.last, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        if self.role is not None and self.role + role[:1] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.role = role[:1]
        fault = _fault(text, first)
        if fault:
            self.counts[fault] += 1
        self.layer.turn(role, text, fault)

    def row(self) -> tuple:
        gaps = self.last - self.least + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.counts.values(), *self.layer.result())


_RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repairs(rows: DataFrame) -> DataFrame:
    """One row a conversation of (conv_id, turn, role, text and, if wanted, ``gone``): its faults, and cost, audit and SHA-256 of its
    cheapest repair (forward Viterbi over four states; see the contract of operator 13 for the edits).

    Rows with ``gone`` only keep their conversation. Null roles and texts are one space; an empty role has no initial, so it is rerolled or
    deleted; null turns come first, equal ones go by role and text; a null conv_id is a conversation of its own. An empty table gives
    no rows; other columns are not read. A conversation's turns are streamed through one task, sorted outside memory: its
    digest is a chain. The task holds four states and a byte a turn, whatever the conversation's length.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, done = None, []

        def given() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * len(_RESULT)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        schema = None
        for batch in batches:
            if schema is None:
                schema = pa.schema([("conv_id", batch.schema.field(0).type), *((n, pa.int64()) for n in _RESULT[1:7]), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for conv_id, turn, role, text, gone, first in zip(*(c.to_pylist() for c in batch.columns)):
                if open_ is None or conv_id != open_.conv_id:
                    if open_ is not None:
                        done.append(open_.row())
                    open_ = _Repair(conv_id)
                if not gone:
                    open_.add(turn, role, text, first)
            yield given()
            done = []
        if open_ is not None:
            done.append(open_.row())
            yield given()

    kind = rows.schema["conv_id"].dataType.simpleString()
    return _in_order(rows).mapInArrow(each, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place long, turn, role, text, edit) of every turn of the repaired conversations: edit is K, R or I, place counts from 0,
    inserted turns have no turn number. Nulls and ties as in ``repairs``; conversations that are deleted whole have no rows."""
    turn, conv = (rows.schema[c].dataType.simpleString() for c in ("turn", "conv_id"))
    found = repairs(rows)
    audits = found.select("conv_id", F.lit(None).cast(turn).alias("turn"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("side"))
    ordered = rows.where(~F.coalesce("gone", F.lit(False))) if "gone" in rows.columns else rows
    turns = ordered.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).alias("side"))
    both = audits.unionByName(turns).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "side", F.col("turn").asc_nulls_first(), "role", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, place, conv_id = "", 0, NOTHING, 0, None

        def inserts(out: list) -> None:
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                out.append((conv_id, place, None, _ROLE[state], "", "I"))
                at, state, place = at + 1, _AFTER[state], place + 1

        for batch in batches:
            out: list[tuple] = []
            for conv, turn_, role, text, side in zip(*(c.to_pylist() for c in batch.columns)):
                if side == 0:
                    audit, at, state, place, conv_id = text, 0, NOTHING, 0, conv
                else:
                    edit, at = audit[at], at + 1
                    if edit != "D":
                        role = role if edit == "K" else _ROLE[state]
                        state = _TO[role[:1]][state]
                        out.append((conv, place, turn_, role, text, edit))
                        place += 1
                inserts(out)
            columns = list(zip(*out)) or [()] * 6
            types = [batch.schema.field(0).type, pa.int64(), batch.schema.field(1).type, pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", "place", "turn", "role", "text", "edit"])

    return both.mapInArrow(each, f"conv_id {conv}, place long, turn {turn}, role string, text string, edit string")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages ``conversations`` as the contract says and repairs every conversation; see ``repairs``."""
    return repairs(damage(table(spark, sf_dir, "conversations")))
