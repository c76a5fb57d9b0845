"""Repair of conversations by iterative-deepening A* over edits of their turns."""

from __future__ import annotations

import hashlib
import math
import os.path
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.llm._work import slices, stored

#: Turns searched at a time; longer conversations are joined from such pieces.
PIECE_TURNS = 64
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: A repaired conversation may end here.
ACCEPTING = (START, ASSISTANT)
#: Exit state of a piece that is known to end its conversation.
ENDED = 4
#: Edits in ASCII order, and what they cost; a truncated turn that stays adds its price.
DELETE, INSERT, KEEP, REROLE = "D", "I", "K", "R"
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 2, 5, 1, 5
#: Faults of a turn.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)

#: States that can still be reached from each.
_AHEAD = ({0, 1, 2, 3}, {1, 2, 3}, {2, 3}, {2, 3})
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_LEGAL = {"su", "ua", "au"}

Turn = tuple[str, int]  # first letter of the role, fault


def _spoken(state: int) -> int:
    """The state after a turn of whoever has to speak next."""
    return ASSISTANT if state == USER else USER


def cheapest_edits(turns: list[Turn], start: int, goals: tuple[int, ...]) -> tuple[int, str] | None:
    """Cost and initials of the cheapest edits of ``turns`` that lead from ``start`` into a state of ``goals``.

    Iterative-deepening A*: a depth-first search in ASCII order of the edits
    under a cost bound, which then rises to the least estimate that exceeded it.
    The estimate is the price of what no edit can avoid in the turns to come. The
    transposition table holds, for each place and state that failed, the cost
    that is needed from there at least; it stays true under later bounds. The
    first accepting path has the least cost and is the first in ASCII order.
    """
    n, wanted = len(turns), set(goals)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (DELETE_COST if turns[i][1] else 0)
    needed: dict[tuple[int, int], float] = {}

    def edits(at: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        if at < n:
            initial, fault = turns[at]
            yield DELETE, DELETE_COST, at + 1, state
        yield INSERT, INSERT_COST, at, _spoken(state)
        if at < n and fault not in (BLANK, DUPLICATE):
            price = TRUNCATED_COST if fault == TRUNCATED else 0
            after = _KEPT.get((state, initial))
            if after is not None:
                yield KEEP, price, at + 1, after
            yield REROLE, price + REROLE_COST, at + 1, _spoken(state)

    def descend(at: int, state: int, budget: float) -> tuple[str | None, float]:
        least = needed.get((at, state), ahead[at])
        if least > budget:
            return None, least
        if at == n and state in wanted:
            return "", 0
        least = math.inf
        for edit, cost, then, after in edits(at, state):
            if wanted & _AHEAD[after]:
                rest, more = descend(then, after, budget - cost)
                if rest is not None:
                    return edit + rest, 0
                least = min(least, cost + more)
        needed[at, state] = least
        return None, least

    if not wanted & _AHEAD[start]:
        return None
    bound: float = ahead[0]
    while bound < math.inf:
        path, more = descend(0, start, bound)
        if path is not None:
            return int(bound), path
        bound = more
    return None


def initial(role: str) -> str:
    return role[:1]


def _piece(turns: list[tuple], first: bool, last: bool) -> dict:
    """Counts and cheapest edits of consecutive ``turns`` (turn, role, fault), for each way to enter and leave."""
    numbers = [t for t, _, _ in turns if t is not None]
    letters = [initial(role) for _, role, _ in turns]
    faults = [fault for _, _, fault in turns]
    searched = list(zip(letters, faults, strict=True))
    paths = []
    for start in (START,) if first else range(4):
        for goal in (ENDED,) if last else range(4):
            found = cheapest_edits(searched, start, ACCEPTING if last else (goal,))
            if found:
                paths.append({"p": start, "q": goal, "cost": found[0], "audit": found[1]})
    return {
        "low": min(numbers, default=None),
        "high": max(numbers, default=None),
        "turns": len(set(numbers)),
        "blank": faults.count(BLANK),
        "duplicate": faults.count(DUPLICATE),
        "truncated": faults.count(TRUNCATED),
        "illegal": sum(x + y not in _LEGAL for x, y in zip(letters, letters[1:], strict=False)),
        "head": letters[0],
        "tail": letters[-1],
        "paths": paths,
    }


_PIECES = (
    "conv string, part int, seq long, low long, high long, turns long, blank long, duplicate long, truncated long, "
    "illegal long, head string, tail string, paths array<struct<p:int,q:int,cost:long,audit:string>>"
)


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _searching(piece_turns: int, schema: pa.Schema):
    """Pieces of the conversations of a sorted partition.

    Only the first conversation of a partition can have begun before it, and only
    the last one can go on after it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, turns, seq, begun_here = TaskContext.get().partitionId(), None, [], 0, False
        out: list[dict] = []

        def close(last: bool) -> None:
            piece = _piece(turns, begun_here and seq == 0, last)
            out.append({"conv": conv, "part": part, "seq": seq, **piece})

        for batch in slices(batches):
            columns = (batch.column(n).to_pylist() for n in ("conv", "turn", "role", "fault"))
            for key, turn, role, fault in zip(*columns, strict=True):
                if key != conv:
                    if conv is not None:
                        close(True)
                    begun_here = conv is not None
                    conv, turns, seq = key, [], 0
                elif len(turns) == piece_turns:
                    close(False)
                    turns, seq = [], seq + 1
                turns.append((turn, role, fault))
            if out:
                yield _batch(out, schema)
                out = []
        if conv is not None:
            close(False)
            yield _batch(out, schema)

    return run


class _Joined:
    """The pieces of one conversation, joined in order."""

    def __init__(self) -> None:
        self.sums = dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal"), 0)
        self.low = self.high = self.tail = None
        #: cheapest edits per state, without what all of them begin with
        self.open: dict[int, tuple[int, str]] = {START: (0, "")}
        self.settled: list[str] = []

    def add(self, piece: dict) -> None:
        for name in self.sums:
            self.sums[name] += piece[name]
        if self.tail is not None and self.tail + piece["head"] not in _LEGAL:
            self.sums["illegal"] += 1
        if piece["low"] is not None:
            if self.high == piece["low"]:
                self.sums["turns"] -= 1
            self.low = piece["low"] if self.low is None else self.low
            self.high = piece["high"]
        self.tail = piece["tail"]
        reached: dict[int, tuple[int, str]] = {}
        for path in piece["paths"]:
            if path["p"] in self.open:
                cost, audit = self.open[path["p"]]
                found = (cost + path["cost"], audit + path["audit"])
                reached[path["q"]] = min(found, reached.get(path["q"], found))
        common = os.path.commonprefix([audit for _, audit in reached.values()])
        self.settled.append(common)
        self.open = {q: (cost, audit[len(common) :]) for q, (cost, audit) in reached.items()}

    def row(self, conv: str) -> dict:
        cost, audit = min(found for q, found in self.open.items() if q in (*ACCEPTING, ENDED))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.sums["turns"]
        return {"conv": conv, "gaps": gaps, **self.sums, "cost": cost, "audit": "".join(self.settled) + audit}


_JOINED = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _per_conversation(schema: pa.Schema, fresh: Callable[[], object], take: Callable, give: Callable):
    """One row per conversation of a partition sorted by it, made by ``take`` from its rows one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held, out = None, None, []
        for batch in slices(batches):
            for row in batch.to_pylist():
                if row["conv"] != conv:
                    if conv is not None:
                        out.append(give(held, conv))
                    conv, held = row["conv"], fresh()
                take(held, row)
            if out:
                yield _batch(out, schema)
                out = []
        if conv is not None:
            yield _batch([give(held, conv)], schema)

    return run


class _Written:
    """Digest of the repaired lines; the edits come first, the turns follow."""

    def __init__(self) -> None:
        self.sha, self.empty, self.audit, self.at, self.state = hashlib.sha256(), True, "", 0, START

    def line(self, role: str, text: str) -> None:
        self.sha.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            self.state = _spoken(self.state)
            self.line("assistant" if self.state == ASSISTANT else "user", "")
            self.at += 1

    def take(self, row: dict) -> None:
        if row["kind"] == 0:
            self.audit = row["text"]
            self.inserts()
            return
        edit = self.audit[self.at]
        self.at += 1
        if edit == KEEP:
            self.state = _KEPT[self.state, initial(row["role"])]
            self.line(row["role"], row["text"])
        elif edit == REROLE:
            self.state = _spoken(self.state)
            self.line("assistant" if self.state == ASSISTANT else "user", row["text"])
        self.inserts()

    def give(self, conv: str) -> dict:
        return {"conv": conv, "repaired_sha256": self.sha.hexdigest()}


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows ``conv, turn, role, text`` after the damage that the CRC-32 of ``conv_id:turn`` decides.

    A row modulo 20: 0 is dropped, 1 loses its text, 2 its full stops, question
    and exclamation marks, 3 comes twice, 4 gets the role user. Nulls count as
    one space, but a null turn stays null.
    """
    blank = F.lit(" ")
    number = F.concat_ws(
        ":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank)
    )
    fate = F.crc32(number) % 20
    text = F.coalesce("text", blank)
    rows = conversations.select(
        _name("conv_id").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.when(fate == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        fate.alias("fate"),
    ).filter("fate <> 0")
    copies = F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("copy", F.explode(copies)).drop("fate", "copy")


def _name(conv_column: str) -> Column:
    """A conversation's id as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv_column).cast("string")), F.lit(""))


_ORDER = ["conv", "turn", "role", "digest"]


def _faulty(rows: DataFrame) -> DataFrame:
    """``rows`` without their texts, with the first ``fault`` of each turn.

    Of equal turns all but the first repeat; equal ones at one place are counted
    before they move, so a turn that is repeated very often is one row until the
    end.
    """
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    light = rows.select(
        *_ORDER,
        F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(FINE).alias("own"),
    )
    counted = light.groupBy(*_ORDER, "own").agg(F.count(F.lit(1)).alias("times"))
    firsts = counted.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("first"))
    known = counted.join(firsts, ["conv", "role", "digest"])
    repeated = ~F.col("first.turn").eqNullSafe(F.col("turn")) | (F.col("n") > 1)
    fault = F.when(F.col("own") == BLANK, BLANK).when(repeated, DUPLICATE).otherwise(F.col("own"))
    spread = known.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return spread.select(*_ORDER, "n", fault.alias("fault"))


def repair_conversations(
    conversations: DataFrame,
    piece_turns: int = PIECE_TURNS,
    damage: Callable[[DataFrame], DataFrame] = damaged,
) -> DataFrame:
    """Faults, cheapest repair and digest of the repaired text of every conversation.

    ``conversations`` has ``conv_id, turn, role, text``; ``damage`` makes the
    rows ``conv, turn, role, text`` that are examined. Returns ``conv_id, gaps,
    blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Faults, counts and edits need no texts: light rows are sorted by range, so
    the turns of one conversation may lie in many tasks. Each task searches
    pieces of ``piece_turns`` turns (see ``cheapest_edits``), for every state in
    which the piece may be entered and left; joining the pieces in order gives
    the cheapest edits of the whole conversation, the first in ASCII order among
    them, for two equally cheap edits of the same turns into the same state never
    begin each other. The texts then move once, to where their conversation is
    written; they stream into the digest behind the edits, so a task holds one
    batch of them, but the digest of one conversation is the work of one task.

    Turns of one number are ordered by role and by digest of their text. Null
    conversation ids are one conversation; nulls in role and text are one space.
    Repeated rows repeat their turn and are duplicates. Conversations without
    rows after the damage have zeros, no edits and the digest of the empty text.
    An empty table gives an empty one; further columns are ignored.
    """
    named = conversations.select("conv_id", "turn", "role", "text")
    rows = damage(named).withColumn("digest", F.unhex(F.md5("text")))
    pieces = (
        _faulty(rows)
        .repartitionByRange(*_ORDER, "n")
        .sortWithinPartitions(*_ORDER, "n")
        .mapInArrow(_searching(piece_turns, _arrow_schema(_PIECES)), _PIECES)
    )
    pieces = stored(pieces, "pieces").repartition("conv").sortWithinPartitions("conv", "part", "seq")
    joined = pieces.mapInArrow(
        _per_conversation(_arrow_schema(_JOINED), _Joined, _Joined.add, _Joined.row), _JOINED
    )
    joined = stored(joined, "repairs")

    none = F.lit(None)
    edits = joined.select(
        "conv", none.cast("long").alias("turn"), none.cast("string").alias("role"),
        none.cast("binary").alias("digest"), F.col("audit").alias("text"), F.lit(0).alias("kind"),
    )
    texts = edits.unionByName(rows.select(*_ORDER, "text", F.lit(1).alias("kind")))
    written = "conv string, repaired_sha256 string"
    digests = (
        texts.repartition("conv")
        .sortWithinPartitions("conv", "kind", "turn", "role", "digest")
        .mapInArrow(_per_conversation(_arrow_schema(written), _Written, _Written.take, _Written.give), written)
    )
    zero = F.lit(0).cast("long")
    return (
        named.select("conv_id", _name("conv_id").alias("conv"))
        .distinct()
        .join(joined, "conv", "left")
        .join(digests, "conv", "left")
        .select(
            "conv_id",
            *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
        )
    )
