"""Cheapest repairs of conversations, by a dynamic program with square-root checkpoints.

A repaired conversation is empty, or an optional system turn before pairs of a user and an assistant
turn. Rows are kept, given another role, deleted, or preceded and followed by inserted turns; the
cheapest way is taken, and the one whose edits read least in ASCII among equally cheap ones.

What is left to pay from a place on is a vector over four states. Walking backwards, these vectors
are stored at checkpoints alone, a square root of the rows apart; walking forwards, each block's
vectors are computed again from the next checkpoint and tell at once which edits are cheapest.

Conversations are cut into segments of at most ``SEGMENT_ROWS`` rows, which hold one byte per row and
no text. A conversation within one segment is solved there. Longer ones have checkpoints at the ends
of segments: each segment's costs from state to state are a four by four table, combined backwards
into vectors; then each says where it would end from each state, and only then, its true beginning
known, it writes its edits. So no task holds the rows of a long conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordwood.llm.common import Scratch

SEGMENT_ROWS = 1 << 20
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
INFINITE = 1 << 60

# States: nothing said yet, after the system, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
_AHEAD = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
# A row's code is its initial (0 other, 1 s, 2 u, 3 a) plus four times its fault.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
_LAWFUL_PAIRS = {(1, 2), (2, 3), (3, 2)}
_GAPS = " \t\n\x0b\x0c\r"

_ROW = ["conv_id", "turn", "role", "text"]


def _steps(code: int) -> list[list[tuple[str, int, int]]]:
    """For each state the edits of one row: (letter, state after it, cost), in ASCII order."""
    initial, fault = code & 3, code >> 2
    extra = CUT_OFF if fault == TRUNCATED else 0
    steps = []
    for state in range(4):
        found = [("D", state, DELETE)]
        if fault in (SOUND, TRUNCATED):
            ahead = _AHEAD[state]
            if initial == 1 and state == START:
                found.append(("K", SYSTEM, extra))
            if initial == ahead:
                found.append(("K", ahead, extra))
            found.append(("R", ahead, REROLE + extra))
        steps.append(found)
    return steps


STEPS = [_steps(code) for code in range(16)]


def _inserted(vector: tuple) -> tuple:
    """What is left to pay in each state if turns may be inserted first; two at most are of use."""
    start, system, user, assistant = vector
    user_then = min(user, INSERT + assistant)
    return (
        min(start, INSERT + user_then),
        min(system, INSERT + user_then),
        user_then,
        min(assistant, INSERT + user),
    )


FINAL = _inserted((0, INFINITE, INFINITE, 0))


def _before(code: int, vector: tuple) -> tuple:
    """What is left to pay before a row, from what is left after it (insertions included)."""
    return _inserted(tuple(min(cost + vector[to] for _, to, cost in steps) for steps in STEPS[code]))


def back_over(codes: bytes, vector: tuple) -> tuple:
    """What is left to pay before some rows, from what is left after them."""
    for code in reversed(codes):
        vector = _before(code, vector)
    return vector


def walk(codes: bytes, after: tuple, state: int, last: bool = True) -> tuple[list[str], int]:
    """The least of the cheapest edits of some rows, from a state, and the state they end in.

    ``after`` is what is left to pay behind them, insertions there included. Each row's edits begin
    with the insertions before it. The ones behind the last row are a string of their own if
    nothing follows (``last``, so that ``after`` is ``FINAL``).
    """
    size = len(codes)
    step = max(1, isqrt(size))
    checkpoints, vector = {size: after}, after
    for at in range(size - 1, -1, -1):
        vector = _before(codes[at], vector)
        if at % step == 0:
            checkpoints[at] = vector
    edits = []
    for begin in range(0, size, step):
        end = min(begin + step, size)
        block = [checkpoints[end]]
        for at in range(end - 1, begin, -1):
            block.append(_before(codes[at], block[-1]))
        block.append(checkpoints[begin])
        for at in range(begin, end):
            edit, state = _row_edits(codes[at], block[end - at], block[end - at - 1], state)
            edits.append(edit)
    if last:
        edits.append("I" * (after[state] // INSERT))
    return edits, state


def _row_edits(code: int, here: tuple, after: tuple, state: int) -> tuple[str, int]:
    """Insertions before a row and what is done to it: each time the least letter that is cheapest."""
    edit = ""
    while True:
        left = here[state]
        paying = [(letter, to) for letter, to, cost in STEPS[code][state] if cost + after[to] == left]
        if INSERT + here[_AHEAD[state]] == left:
            paying.append(("I", _AHEAD[state]))
        letter, to = min(paying)
        edit, state = edit + letter, to
        if letter != "I":
            return edit, state


def table_of(codes: bytes) -> list[int]:
    """The costs from each state before some rows to each one behind them, row by row."""
    columns = [back_over(codes, tuple(0 if state == to else INFINITE for state in range(4))) for to in range(4)]
    return [min(columns[to][state], INFINITE) for state in range(4) for to in range(4)]


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of conversations, damaged by the checksum of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user. A
    null id, turn, role or text reads as one space there; ids and turns stay null. Returns
    conv_id, turn, role, text, copies (0 where dropped).
    """
    said = [F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in _ROW]
    fate = F.crc32(F.concat(said[0], F.lit(":"), said[1]).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(said[3], "[.!?]", "")).otherwise(said[3])
    return conversations.select(
        "conv_id",
        "turn",
        F.when(fate == 4, "user").otherwise(said[2]).alias("role"),
        text.alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"),
    )


def _order(rows: DataFrame) -> list[Column]:
    """Rows of one turn follow by role and digest of the text, so that equal rows stand together."""
    return [F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text_key")]


def _coded(rows: DataFrame) -> DataFrame:
    """One row per distinct row, without its text: code of the first and of the other copies."""
    said = F.rtrim(F.col("text"), F.lit(_GAPS))
    initial = F.substring("role", 1, 1)
    light = (
        rows.where("copies > 0")
        .select(
            "conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("text_key"), "copies",
            F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0).alias("initial"),
            F.when(said == "", BLANK).when(F.right(said, F.lit(1)).isin(".", "!", "?"), SOUND)
            .otherwise(TRUNCATED).alias("fault"),
        )
        .groupBy("conv_id", "turn", "role", "text_key", "initial", "fault")
        .agg(F.sum("copies").alias("copies"))
    )
    # Counted first, then looked up by all four keys: copies on many turns meet in no single task.
    firsts = (
        light.groupBy("conv_id", "role", "text_key")
        .agg(F.min("turn").alias("turn"), F.max(F.col("turn").isNull()).alias("undated"))
        .select("conv_id", "role", "text_key", F.when(~F.col("undated"), F.col("turn")).alias("turn"), F.lit(True).alias("first"))
        .alias("f")
    )
    keys = [F.col(f"l.{name}").eqNullSafe(F.col(f"f.{name}")) for name in ("conv_id", "turn", "role", "text_key")]
    repeated = F.when(F.col("fault") == BLANK, BLANK).otherwise(DUPLICATE)
    fault = F.when(F.col("first"), F.col("fault")).otherwise(repeated)
    return light.alias("l").join(firsts, keys[0] & keys[1] & keys[2] & keys[3], "left").select(
        *(f"l.{name}" for name in ("conv_id", "turn", "role", "text_key", "copies")),
        (F.col("initial") + 4 * fault).alias("code"),
        (F.col("initial") + 4 * repeated).alias("again"),
    )


def _cut(segment_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        owner, codes, begun = None, bytearray(), False

        def piece(kind: pa.DataType) -> pa.RecordBatch:
            values = [pa.array([owner], kind), pa.array([part], pa.int32()), pa.array([number], pa.int64())]
            return pa.RecordBatch.from_arrays(
                [*values, pa.array([bytes(codes)], pa.binary())], names=["conv_id", "part", "number", "codes"]
            )

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv_id, copies, code, again in zip(*(column.to_pylist() for column in batch.columns)):
                if begun and conv_id != owner and codes:
                    yield piece(kind)
                    number += 1
                    codes.clear()
                owner, begun = conv_id, True
                codes.append(code)
                copies -= 1
                while len(codes) + copies >= segment_rows:
                    taken = segment_rows - len(codes)
                    codes.extend(bytes([again]) * taken)
                    copies -= taken
                    yield piece(kind)
                    number += 1
                    codes.clear()
                codes.extend(bytes([again]) * copies)
        if codes:
            yield piece(kind)

    return run


def _mapped(df: DataFrame, add: str, compute) -> DataFrame:
    """``df`` with one more column, computed from each row as a dictionary."""
    columns = df.columns
    name = add.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [compute(row) for row in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, types[name])], names=[*columns, name])

    types = {
        "costs": pa.list_(pa.int64()), "exits": pa.list_(pa.int32()), "edits": pa.string(),
        "behind": pa.list_(pa.list_(pa.int64())), "entries": pa.list_(pa.int32()),
    }
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, {add}")


def _behind(row: dict) -> list[list[int]]:
    """What is left to pay behind each segment of a conversation."""
    vector, found = FINAL, []
    for segment in reversed(row["segments"]):
        found.append(list(vector))
        costs = segment["costs"]
        vector = tuple(min(costs[4 * state + to] + vector[to] for to in range(4)) for state in range(4))
    return found[::-1]


def _entries(row: dict) -> list[int]:
    """The state in which each segment of a conversation begins."""
    state, found = START, []
    for segment in row["segments"]:
        found.append(state)
        state = segment["exits"][state]
    return found


def _spread(segments: DataFrame, fact: str, add: str, compute, as_name: str, kind: str) -> DataFrame:
    """Fold one small fact of each segment over its conversation and give each its own result.

    A conversation has one segment per ``SEGMENT_ROWS`` rows and one more per range of the sort, so
    the list of its facts stays small.
    """
    gathered = segments.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("part", "number", fact))).alias("segments")
    )
    folded = _mapped(gathered, add, compute).select(
        F.col("conv_id").alias("_conv"), F.posexplode("segments").alias("_at", "_segment"), add.split()[0]
    )
    own = folded.select(
        "_conv", F.col("_segment.part").alias("_part"), F.col("_segment.number").alias("_number"),
        F.element_at(add.split()[0], F.col("_at") + 1).cast(kind).alias(as_name),
        (F.col("_at") + 1 == F.size(add.split()[0])).alias("last"),
    )
    same = (
        F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")) & (F.col("number") == F.col("_number"))
    )
    return segments.drop("last").join(own, same).drop("_conv", "_part", "_number")


def _solved(segments: DataFrame, scratch: Scratch) -> DataFrame:
    """Segments with their edits."""
    several = segments.groupBy("conv_id").count().where("count > 1").select(F.col("conv_id").alias("_conv"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    alone = _mapped(
        segments.join(several, same, "left_anti"), "edits string",
        lambda row: "".join(walk(row["codes"], FINAL, START)[0]),
    )
    long = scratch.store(segments.join(several, same, "left_semi"), "long")
    costed = scratch.store(_mapped(long, "costs array<long>", lambda row: table_of(row["codes"])), "costs")
    after = _spread(costed, "costs", "behind array<array<long>>", _behind, "after", "array<long>")
    ends = _mapped(
        after.drop("costs"), "exits array<int>",
        lambda row: [walk(row["codes"], tuple(row["after"]), state, False)[1] for state in range(4)],
    )
    ended = scratch.store(ends, "exits")
    begun = _spread(ended, "exits", "entries array<int>", _entries, "entry", "int")
    joined = _mapped(
        begun, "edits string",
        lambda row: "".join(walk(row["codes"], tuple(row["after"]), row["entry"], row["last"])[0]),
    )
    columns = ["conv_id", "part", "number", "codes", "edits"]
    return alone.select(columns).unionByName(joined.select(columns))


class _Conversation:
    """One conversation as its audit and then its rows come by; texts are not kept."""

    def __init__(self, conv_id) -> None:
        self.conv_id = conv_id
        self.codes, self.audit = bytearray(), []
        self.at = self.edit = 0
        self.state, self.begun = START, False
        self.turns, self.least, self.turn = 0, None, None
        self.digest = hashlib.sha256()

    def add(self, codes: bytes, edits: str) -> None:
        self.codes += codes
        self.audit.append(edits)

    def ready(self) -> None:
        if len(self.audit) != 1:
            self.audit = ["".join(self.audit)]

    def _say(self, role: str, text: str) -> tuple[str, str]:
        self.digest.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode())
        self.begun = True
        return role, text

    def _ahead(self) -> str:
        self.state = _AHEAD[self.state]
        return "user" if self.state == USER else "assistant"

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """The repaired turns that a row gives: (edit, role, text)."""
        if turn is not None and turn != self.turn:
            self.turns, self.turn = self.turns + 1, turn
            self.least = turn if self.least is None else self.least
        self.at += 1
        edits = self.audit[0]
        while True:
            letter = edits[self.edit]
            self.edit += 1
            if letter == "I":
                yield "I", *self._say(self._ahead(), "")
                continue
            if letter == "K":
                if role.startswith("s"):
                    self.state = SYSTEM
                else:
                    self._ahead()
                yield "K", *self._say(role, text)
            elif letter == "R":
                yield "R", *self._say(self._ahead(), text)
            return

    def rest(self) -> Iterator[tuple[str, str, str]]:
        self.ready()
        for letter in self.audit[0][self.edit :]:
            yield letter, *self._say(self._ahead(), "")
        self.edit = len(self.audit[0])

    def summary(self) -> dict:
        audit, codes = self.audit[0], self.codes
        faults = [sum(codes.count(4 * fault + initial) for initial in range(4)) for fault in range(4)]
        kept = bytes(code for code, edit in zip(codes, (x for x in audit if x != "I")) if edit != "D")
        cut_off = sum(kept.count(4 * TRUNCATED + initial) for initial in range(4))
        edits = audit.count("R") * REROLE + audit.count("D") * DELETE + audit.count("I") * INSERT
        return {
            "conv_id": self.conv_id,
            "gaps": self.turn - self.least + 1 - self.turns if self.turns else 0,
            "blank": faults[BLANK],
            "duplicate": faults[DUPLICATE],
            "truncated": faults[TRUNCATED],
            "illegal": sum((a & 3, b & 3) not in _LAWFUL_PAIRS for a, b in zip(codes, codes[1:])),
            "cost": edits + CUT_OFF * cut_off,
            "audit": audit,
            "repaired_sha256": self.digest.hexdigest(),
        }


_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURNS = "place long, edit string, role string, text string"


def _replay(summaries: bool):
    """Runs through conversations in order and gives their summaries, or their repaired turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, place, schema = None, 0, None

        def told(turns) -> Iterator[dict]:
            nonlocal place
            for edit, role, text in turns:
                if not summaries:
                    yield {"conv_id": current.conv_id, "place": place, "edit": edit, "role": role, "text": text}
                place += 1

        def finish() -> Iterator[dict]:
            yield from told(current.rest())
            if summaries:
                yield current.summary()

        for batch in batches:
            if schema is None:
                schema = _arrow_schema(batch.schema.field("conv_id").type, summaries)
            out = []
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                conv_id, kind, codes, edits, turn, role, text, copies = row
                if current is None or conv_id != current.conv_id:
                    if current is not None:
                        out.extend(finish())
                    current, place = _Conversation(conv_id), 0
                if kind == 0:
                    current.add(codes, edits)
                    continue
                current.ready()
                for _ in range(copies):
                    out.extend(told(current.row(turn, role, text)))
            yield pa.RecordBatch.from_pylist(out, schema)
        if current is not None:
            yield pa.RecordBatch.from_pylist(list(finish()), schema)

    return run


def _arrow_schema(conv_id: pa.DataType, summaries: bool) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [field.split() for field in (_SUMMARY if summaries else _TURNS).split(", ")]
    return pa.schema([("conv_id", conv_id), *((name, kinds[kind]) for name, kind in fields)])


def _replayed(rows: DataFrame, summaries: bool, segment_rows: int) -> DataFrame:
    scratch = Scratch(rows.sparkSession, "repair")
    coded = _coded(rows)
    ordered = coded.repartitionByRange(*_order(coded)).sortWithinPartitions(*_order(coded))
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    segments = scratch.store(
        ordered.select("conv_id", "copies", "code", "again").mapInArrow(
            _cut(segment_rows), f"conv_id {conv_type}, part int, number long, codes binary"
        ),
        "segments",
    )
    audits = _solved(segments, scratch).select(
        "conv_id", F.lit(0).alias("kind"), "part", "number", "codes", "edits",
        *(F.lit(None).cast(rows.schema[name].dataType).alias(name) for name in ("turn", "role", "text", "copies")),
        F.lit(None).cast("binary").alias("text_key"),
    )
    said = rows.select(
        "conv_id", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("long").alias("number"),
        F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("string").alias("edits"),
        "turn", "role", "text", "copies", F.unhex(F.sha2("text", 256)).alias("text_key"),
    )
    together = (
        audits.unionByName(said)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "kind", "part", "number", "turn", "role", "text_key")
        .select("conv_id", "kind", "codes", "edits", "turn", "role", "text", "copies")
    )
    return together.mapInArrow(_replay(summaries), f"conv_id {conv_type}, {_SUMMARY if summaries else _TURNS}")


def repair_summaries(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired form of every conversation.

    ``rows`` are those of ``damaged`` or have its columns: conv_id of any type (null is one more
    conversation), turn (null comes first), role and text without nulls, and copies, how often the
    row stands there; 0 names the conversation only. Other columns are not read. Rows of one turn
    follow by role and by the SHA-256 of their text. A conversation without rows has zeros, an empty
    audit and the digest of nothing; an empty table gives no rows. A text of any length passes
    through one task once; the digest of one conversation is worked out in one task, row by row.
    """
    return _replayed(rows, True, segment_rows)


def repaired_turns(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The turns of all repaired conversations: conv_id, place (from 0), edit, role, text.

    The input is that of ``repair_summaries``; conversations of which nothing is left have no rows.
    """
    return _replayed(rows, False, segment_rows)
