"""Operator 13 against a search over all edits."""

import hashlib
import heapq
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from quotalens.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out += [] if k == 0 else [(conv, turn, role, text)] * (2 if k == 3 else 1)
    return out


def searched(turns, insert=5):
    """Shortest path over (turns answered for, last initial), ordered by cost and audit; whole audits and texts are carried."""
    turns = sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in turns:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(turns) and last in ("", "a"):
            break
        offers = [(insert, "I", i, role, f"{role}:") for role in ("user", "assistant")]
        if i < len(turns):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, lines))
            role, text = turns[i][2:]
            if faults[i] in (None, "truncated"):
                more = 5 if faults[i] else 0
                offers += [(more, "K", i + 1, role, f"{role}:{text}"), *((more + 1, "R", i + 1, r, f"{r}:{text}") for r in ("user", "assistant"))]
        for more, letter, to, role, line in offers:
            if (last, role[:1]) in STEPS:
                heapq.heappush(heap, (cost + more, audit + letter, to, STEPS[last, role[:1]], (*lines, line)))
    numbers = [t[1] for t in turns if t[1] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = [t[2][:1] for t in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def expected(rows):
    by = {r[0]: [] for r in rows}
    for r in damaged(rows):
        by[r[0]].append(r)
    return {conv: searched(turns) for conv, turns in by.items()}


def rows_of(seed, n, turns=(1, 2, 5, 9, 30)):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "u", "a", "s", "tool", "", None], ["a.", "b!", "c", "", " \t", None, "Hello there.", "ünï?"]
    return [
        (c or None, rng.choice([t, t, t, None, t + 2]), rng.choice(roles), rng.choice([*texts, f"ok?{t}", f"ok {t}."]))
        for c in range(n) for t in range(rng.choice(turns))
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_repairs_are_the_cheapest_and_least(spark, seed):
    rows = rows_of(seed, 250)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = expected(rows)
    got = {r[0]: tuple(r)[1:] for r in conversations.repairs(conversations.damage(df)).collect()}
    assert got == want
    assert {"K", "R", "D"} == set("".join(w[6] for w in want.values())) and any(w[6] == "" for w in want.values())
    lines = {}
    for r in sorted(conversations.repaired_turns(conversations.damage(df)).collect(), key=lambda r: (str(r.conv_id), r.place)):
        assert (r.edit == "I") == (r.turn is None and r.text == "") or r.edit in "KR"
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == w[-1] for conv, w in want.items())


@pytest.mark.parametrize("insert", [1, 2])
def test_cheap_inserts(monkeypatch, insert):
    """At the contract's costs a deletion always beats an insert; at lower ones inserts are made, and still the least audit wins."""
    monkeypatch.setattr(conversations, "INSERT", insert)
    audits = ""
    by: dict = {}
    for row in rows_of(11, 300):
        by.setdefault(row[0], []).append(row[:2] + tuple(" " if x is None else x for x in row[2:]))
    for conv, turns in by.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        repair, seen = conversations._Repair(conv), set()
        for _, turn, role, text in turns:
            repair.add(turn, role, text, (role, text) not in seen)
            seen.add((role, text))
        assert repair.row()[1:] == searched(turns, insert)
        audits += repair.row()[7]
    assert audits.count("I") > (100 if insert == 1 else 0)


def test_query_on_the_test_tables(spark):
    path = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r)[1:] for r in conversations.op13_conversation_repair(spark, path).collect()} == expected(rows)


@pytest.mark.parametrize("kind", ["mixed", "deleted"])
def test_long_conversation_takes_linear_time(spark, kind):
    """Audits of thousands of turns, also where the four states never meet again; keys are shortened on the way."""
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "tool"]), f"t{t}" + rng.choice([".", ""])) if kind == "mixed" or t < 2 else (1, t, "user", " ") for t in range(6000)]
    took = []
    for n in (3000, 6000):
        df = spark.createDataFrame(rows[:n], SCHEMA)
        began = time.time()
        got = {r[0]: tuple(r)[1:] for r in conversations.repairs(df).collect()}
        took.append(time.time() - began)
        if n == 3000:
            assert got == {1: searched(rows[:n])}
        assert len(got[1][6]) >= n
    assert took[1] < 4 * took[0] + 2


def test_odd_tables(spark):
    empty = conversations.repairs(conversations.damage(spark.createDataFrame([], SCHEMA)))
    assert empty.count() == 0 and empty.columns == conversations._RESULT
    rows = rows_of(7, 40)
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("first", "gone_", "copy", "k", "cost", "audit", "place", "side"):
        df = df.withColumn(name, F.lit("clash"))
    assert {r[0]: tuple(r)[1:] for r in conversations.repairs(conversations.damage(df)).collect()} == expected(rows)
    alone = [(None, None, None, None), (2, None, "user", "Hi."), (2, None, "user", "Hi."), (3, 1, "assistant", "x" * 2_000_000 + ".")]
    got = {r[0]: tuple(r)[1:] for r in conversations.repairs(spark.createDataFrame(alone, SCHEMA)).collect()}
    assert got[None][1] == 1 and got[2][2] == 1 and got[3] == searched(alone[3:])
