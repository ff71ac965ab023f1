"""Chat formatting: layouts recognised by their field paths, one template with a loss mask.

A layout is a set of nested field paths and a declarative mapping from them to turns. The hash of
the paths that a record (or a table) has, among all paths that any layout knows, selects the
mapping; unknown fields beside them change nothing. Turns then go through one template whose
control strings are escaped, reversibly, wherever they stand in a text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

TURN, END = "<|turn|>", "<|end|>\n"
# Strings that chat templates use for control.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
# Names of the three roles in public data sets.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Either one field that lists turns, or fields that are a turn of a fixed role each.

    ``rows`` layouts have one turn per row, with the conversation and its order beside it.
    """

    paths: tuple[str, ...]
    listed: tuple[str, str, str] | None = None  # list, role, text
    turns: tuple[tuple[str, str], ...] = ()  # (role, field); fields join with a line break
    rows: tuple[str, str, str, str] | None = None  # conversation, order, role, text

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


def fingerprint(paths: tuple[str, ...] | list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


LAYOUTS = (
    Layout(("conv_id", "turn", "role", "text"), rows=("conv_id", "turn", "role", "text")),
    Layout(("messages[].role", "messages[].content"), listed=("messages", "role", "content")),
    Layout(("conversations[].from", "conversations[].value"), listed=("conversations", "from", "value")),
    Layout(("prompt", "completion"), turns=(("user", "prompt"), ("assistant", "completion"))),
    Layout(("prompt", "response"), turns=(("user", "prompt"), ("assistant", "response"))),
    Layout(("system", "prompt", "response"), turns=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout(("question", "answer"), turns=(("user", "question"), ("assistant", "answer"))),
    Layout(("instruction", "output"), turns=(("user", "instruction"), ("assistant", "output"))),
    Layout(
        ("instruction", "input", "output"),
        turns=(("user", "instruction"), ("user", "input"), ("assistant", "output")),
    ),
)
KNOWN = sorted({path for layout in LAYOUTS for path in layout.paths})
LISTS = sorted({layout.listed[0] for layout in LAYOUTS if layout.listed})


def schema_paths(kind: DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a schema; ``[]`` stands for the elements of a list."""
    if isinstance(kind, StructType):
        dot = f"{prefix}." if prefix else ""
        return [path for field in kind.fields for path in schema_paths(field.dataType, dot + field.name)]
    if isinstance(kind, ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def layout_of(df: DataFrame) -> Layout:
    """The layout of a table by its schema: that of all its known fields, else the largest that fits.

    So a column that is called like a field of another layout changes nothing.
    """
    there = schema_paths(df.schema)
    wanted = fingerprint([path for path in there if path in KNOWN])
    fitting = [layout for layout in LAYOUTS if set(layout.paths) <= set(there)]
    for layout in fitting:
        if layout.fingerprint == wanted:
            return layout
    if not fitting:
        raise ValueError("no layout has these fields: " + ", ".join(there))
    return max(fitting, key=lambda layout: len(layout.paths))


def record_fingerprint(record: Column) -> Column:
    """The fingerprint of the known field paths of a JSON record."""
    inner = [_prefixed(record, name) for name in LISTS]
    found = F.concat(F.coalesce(F.json_object_keys(record), F.array().cast("array<string>")), *inner)
    known = F.array_sort(F.array_intersect(found, F.array(*map(F.lit, [*KNOWN, *(f"{name}[]" for name in LISTS)]))))
    return F.sha2(F.array_join(known, "\n"), 256)


def _prefixed(record: Column, name: str) -> Column:
    """The paths of all elements of a list; its own name too if an element has other layouts' fields."""
    none = F.array().cast("array<string>")
    own, others = (
        F.array(*map(F.lit, sorted({x for y in LAYOUTS if y.listed and (y.listed[0] == name) == is_own for x in y.listed[1:]})))
        for is_own in (True, False)
    )
    elements = F.from_json(F.get_json_object(record, f"$.{name}"), "array<string>")
    keys = F.coalesce(F.transform(elements, lambda element: F.coalesce(F.json_object_keys(element), none)), F.array(none))

    def odd(found: Column) -> Column:
        has = F.size(F.array_intersect(found, own))
        return (has == 0) | (has < F.size(own)) & F.arrays_overlap(found, others)

    paths = F.transform(F.array_distinct(F.flatten(keys)), lambda key: F.concat(F.lit(f"{name}[]."), key))
    return F.concat(paths, F.when(F.exists(keys, odd) & elements.isNotNull(), F.array(F.lit(f"{name}[]"))).otherwise(none))


def _role(role: Column) -> Column:
    named = F.coalesce(role, F.lit(""))
    pairs = [F.lit(x) for pair in ROLES.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[named], named)


def _turns(record: Column, layout: Layout) -> Column:
    """A record's turns as an array of (role, text)."""
    if layout.listed:
        name, role, text = layout.listed
        listed = F.from_json(
            F.get_json_object(record, f"$.{name}"), f"array<struct<`{role}`: string, `{text}`: string>>"
        )
        return F.transform(
            listed,
            lambda turn: F.struct(_role(turn[role]).alias("role"), F.coalesce(turn[text], F.lit("")).alias("text")),
        )
    said: dict[str, list[Column]] = {}
    for role, field in layout.turns:
        said.setdefault(role, []).append(F.get_json_object(record, f"$.{field}"))
    return F.array(
        *(
            F.struct(F.lit(role).alias("role"), F.concat_ws("\n", *(F.nullif(x, F.lit("")) for x in fields)).alias("text"))
            for role, fields in said.items()
        )
    )


def turns_of_records(records: DataFrame, key: str, record: str) -> DataFrame:
    """Canonical turn rows (conv_id, place, role, text) of JSON records of any known layout.

    A record of no known layout, or no JSON object, gives one row with a null role and itself as
    text, so that nothing is lost without notice.
    """
    marked = records.select(F.col(key).alias("conv_id"), F.col(record).alias("_record")).withColumn(
        "_print", record_fingerprint(F.col("_record"))
    )
    unknown = F.array(F.struct(F.lit(None).cast("string").alias("role"), F.col("_record").alias("text")))
    turns = unknown
    for layout in LAYOUTS:
        if not layout.rows:
            turns = F.when(
                F.col("_print") == layout.fingerprint, F.coalesce(_turns(F.col("_record"), layout), unknown)
            ).otherwise(turns)
    return (
        marked.select("conv_id", turns.alias("_turns"))
        .select("conv_id", F.posexplode_outer("_turns").alias("place", "_turn"))
        .select("conv_id", F.col("place").cast("long"), "_turn.role", "_turn.text")
    )


def turns_of_rows(df: DataFrame) -> DataFrame:
    """Canonical turn rows of a table with one turn per row.

    Turns of a conversation are in the order of their number (null first), then role, then text;
    rows without a conversation id are one conversation. Null roles and texts are empty.
    An empty table gives no rows.
    """
    layout = layout_of(df)
    if not layout.rows:
        raise ValueError("this table has no row per turn")
    conversation, order, role, text = (F.col(name) for name in layout.rows)
    rows = df.select(
        conversation.alias("conv_id"),
        order.alias("turn"),
        F.coalesce(role, F.lit("")).alias("role"),  # as the table has it
        F.coalesce(text, F.lit("")).alias("text"),
    )
    place = "row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1"
    return rows.selectExpr("conv_id", f"CAST({place} AS LONG) AS place", "role", "text")


def escape(text: Column) -> Column:
    """Put a backslash into every control string, after its first character."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROL:
        out = F.replace(out, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return out


_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[0] == "\\n" else m[1], text)


def format_turns(turns: DataFrame) -> DataFrame:
    """The formatted text of each conversation, one row per turn, with the loss mask.

    Returns conv_id, place, formatted (concatenated in the order of place it is the text),
    begins (code points before it), loss_start and loss_length (the masked span, in code points
    from the start of the conversation; null where nothing is learnt). Conversations of any length
    are written turn by turn; only running sums go over a whole one.
    """
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(TURN), role, F.lit("\n"))
    parts = turns.select(
        "conv_id", "place", "role", head.alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body")
    ).select(
        "conv_id",
        "place",
        (F.col("role") == "assistant").alias("learnt"),
        F.char_length("head").cast("long").alias("head_length"),
        F.char_length("body").cast("long").alias("loss_length"),
        F.concat("head", "body", F.lit(END)).alias("formatted"),
    )
    begins = (
        "sum(char_length(formatted)) OVER (PARTITION BY conv_id ORDER BY place"
        " ROWS UNBOUNDED PRECEDING) - char_length(formatted) AS begins"
    )
    return parts.selectExpr("*", begins).select(
        "conv_id",
        "place",
        "formatted",
        "begins",
        F.when(F.col("learnt"), F.col("begins") + F.col("head_length")).alias("loss_start"),
        F.when(F.col("learnt"), F.col("loss_length")).alias("loss_length"),
    )


class _Reader:
    """Reads the formatted text of one conversation piece by piece."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.turns, self.seen, self.loss_chars = conv_id, 0, 0, 0
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, piece: str, loss_start: int | None, loss_length: int | None) -> None:
        for turn in piece.split(END)[:-1]:
            role, _, text = turn.removeprefix(TURN).partition("\n")
            self.said.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
            self.turns += 1
        if loss_start is not None:
            at = loss_start - self.seen
            learnt = unescape(piece[at : at + loss_length])
            self.loss.update(learnt.encode())
            self.loss_chars += len(learnt)
        self.seen += len(piece)

    def row(self) -> tuple:
        return (self.conv_id, self.turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.seen)


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its formatted text and loss mask say: counts and digests.

    Rows stream through in order; a task holds one piece and the running digests at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rows = None, []
        for batch in batches:
            for conv_id, piece, start, length in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if reader is None or reader.conv_id != conv_id:
                    if reader is not None:
                        rows.append(reader.row())
                    reader = _Reader(conv_id)
                reader.read(piece, start, length)
            if rows:
                yield _batch(rows)
                rows = []
        if reader is not None:
            rows.append(reader.row())
        if rows:
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [part.split()[0] for part in _READ.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    return (
        formatted.repartition("conv_id")
        .sortWithinPartitions("conv_id", "place")
        .select("conv_id", "formatted", "loss_start", "loss_length")
        .mapInArrow(run, _READ)
    )
