"""Repaired conversations against Dijkstra's algorithm over whole conversations."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from innsight.llm import repair
from tests.llm.conftest import SMALL

BLANKS = " \t\n\v\f\r"
NAMES = {"a": "assistant", "u": "user"}
SCHEMA = "conv_id long, turn long, role string, text string"


def _cheapest(turns):
    """Cost and audit of (initial, fault) turns: the first whole path in order of cost and audit."""
    heap, done = [(0, "", 0, "^")], set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(turns) and state in "^a":
            return cost, audit
        want = "a" if state == "u" else "u"
        heapq.heappush(heap, (cost + 5, audit + "I", at, want))
        if at < len(turns):
            initial, fault = turns[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state))
            if fault not in (repair.BLANK, repair.DUPLICATE):
                price = 5 if fault == repair.TRUNCATED else 0
                if initial == want or (state == "^" and initial == "s"):
                    heapq.heappush(heap, (cost + price, audit + "K", at + 1, initial))
                heapq.heappush(heap, (cost + price + 1, audit + "R", at + 1, want))
    raise AssertionError


def _brute(rows):
    said = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        said += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    said.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in said:
        bare = text.strip(BLANKS)
        repeated = (role, text) in seen
        faults.append(
            repair.BLANK if not bare else repair.DUPLICATE if repeated else repair.FINE if bare[-1] in ".!?" else repair.TRUNCATED
        )
        seen.add((role, text))
    numbers = [t for t, _, _ in said if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    letters = [r[:1] for _, r, _ in said]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(letters, letters[1:], strict=False))
    cost, audit = _cheapest(list(zip(letters, faults, strict=True)))
    lines, at, state = [], 0, "^"
    for edit in audit:
        want = "a" if state == "u" else "u"
        if edit == "I":
            lines.append(f"{NAMES[want]}:")
            state = want
            continue
        _, role, text = said[at]
        at += 1
        if edit != "D":
            lines.append(f"{role if edit == 'K' else NAMES[want]}:{text}")
            state = role[:1] if edit == "K" else want
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in (repair.BLANK, repair.DUPLICATE, repair.TRUNCATED)), illegal, cost, audit, sha)


def _check(frame, rows, piece_turns):
    grouped = defaultdict(list)
    for row in rows:
        grouped[row[0]].append(row)
    got = repair.repair_conversations(frame, piece_turns).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {conv: _brute(some) for conv, some in grouped.items()}
    assert len(got) == len(grouped)


@pytest.mark.parametrize("seed", range(4))
def test_search_is_cheapest_and_first(seed):
    rng = random.Random(seed)
    for _ in range(400):
        turns = [(rng.choice("suuaax "), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(9))]
        assert repair.cheapest_edits(turns, repair.START, repair.ACCEPTING) == _cheapest(turns)


def test_states_that_cannot_be_reached():
    assert repair.cheapest_edits([("u", 0)], repair.USER, (repair.START,)) is None
    assert repair.cheapest_edits([("u", 0)], repair.SYSTEM, (repair.SYSTEM,)) == (2, "D")
    assert repair.cheapest_edits([("u", 0)], repair.START, (repair.SYSTEM,)) is None
    assert repair.cheapest_edits([], repair.START, (repair.USER,)) == (5, "I")


@pytest.mark.parametrize("piece_turns", [64, 3])
def test_repair(spark, piece_turns):
    rng = random.Random(1)
    rows = [
        (
            conv,
            rng.choice([None, k, k, k, k, k + 3]),
            rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool", ""]),
            rng.choice(["Hi.", "What", "Yes!", "", "  ", "ok?", "a.\n ", None, "b", "漢。", "x" * 5000]),
        )
        for conv in [*range(150), None]
        for k in range(rng.choice([1, 2, 5, 9, 14]))
    ]
    rows += [(7, 2, "user", "Said very often.")] * 300
    rows += [
        (999, k, rng.choice(["user", "assistant", "system"]), f"{rng.choice(['Hi', 'What'])}{rng.randrange(60)}{rng.choice(['.', ''])}")
        for k in range(700)
    ]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS conv", "1 AS kind", "2 AS fault", "3 AS gaps")
    _check(frame.repartition(8), rows, piece_turns)


def test_dropped_and_empty(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(conv, 0, "user", "Gone.")]
    got = repair.repair_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table(spark):
    frame = spark.read.parquet(f"{SMALL}/conversations.parquet")
    _check(frame, [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()], 64)
