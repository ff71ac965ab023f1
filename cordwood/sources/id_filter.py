"""Which ids a log table may hold: a blocked Bloom filter, stored beside the table and merged by OR.

Copies of an id have the same time, so there is a filter per hour of log time. It has ``blocks``
blocks of 512 bits; an id sets one bit in each of the eight words of one block. A batch stores the
blocks it touches as rows, words that meet later are combined with OR: by any reader, and for good
when batches of a closed day are merged. An id whose bits are not all there was never stored; one
whose bits are may have been, and is looked up.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cordwood.sources.log_table import REWRITTEN, DayTable, LogTable, escaped, unescaped

# Blocks per hour: with 32 ids to a block, about one new id in 1,700 is looked up in vain.
BLOCKS = 1 << 17
WORDS = [f"w{k}" for k in range(8)]
GEOMETRY, COVERED = "_geometry", "_covered"
# Hours that are asked for by name; more are asked for as a span.
NAMED_HOURS = 200

FILTER_SCHEMA = T.StructType(
    [
        T.StructField("hour", T.TimestampNTZType()),
        T.StructField("block", T.IntegerType()),
        *(T.StructField(word, T.LongType()) for word in WORDS),
    ]
)


def combined(rows: DataFrame) -> DataFrame:
    """Rows of one block as one row with the bits of all."""
    keys = [name for name in rows.columns if name not in WORDS]
    return rows.groupBy(*keys).agg(*(F.bit_or(word).alias(word) for word in WORDS))


def _places(id_: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of an id, and its bit in each word."""
    block = F.pmod(F.xxhash64(id_), F.lit(blocks)).cast("int")
    spread = F.xxhash64(id_, F.lit("bits"))
    # Six bits of the hash for each of the eight words.
    bits = [
        F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(spread, 6 * k).bitwiseAND(63).cast("int"))
        for k in range(8)
    ]
    return block, bits


class IdFilter:
    """The filter of one log table, in the folder ``<table>-ids``."""

    def __init__(self, spark: SparkSession, table: LogTable, blocks: int = BLOCKS) -> None:
        self.spark, self.table = spark, table
        self.rows = DayTable(spark, f"{table.path}-ids", FILTER_SCHEMA, "hour", ("hour", "block"), combined)
        # Blocks can only be combined if all were made for the same number of them.
        if self.rows.files.exists(GEOMETRY):
            blocks = json.loads(self.rows.files.read(GEOMETRY))["blocks"]
        else:
            self.rows.files.write(json.dumps({"blocks": blocks}), GEOMETRY)
        self.blocks = blocks

    def placed(self, logs: DataFrame) -> DataFrame:
        """``logs`` with hour, block and words of their ids."""
        block, bits = _places(F.col("id"), self.blocks)
        hour = F.date_trunc("hour", F.col("timestamp").cast("timestamp")).cast("timestamp_ntz")
        return logs.withColumns({"hour": hour, "block": block, **dict(zip(WORDS, bits))})

    def add(self, placed: DataFrame, batch: str) -> None:
        """Store the bits of a batch; before its rows, so that no stored row lacks its bits."""
        self.rows.write(combined(placed.select("hour", "block", *WORDS)), batch)

    def cover(self, days: list[str], batch: str) -> int:
        """Add what was written to these days of the table without its bits, or rewritten since.

        A batch counts as added for good once its name is noted; a batch that is written again gets
        a new note in the table and is added again. Returns how many batches were added.
        """
        added = 0
        rewritten = [unescaped(note) for note in self.table.files.statuses(REWRITTEN)]
        for day in days:
            held = self.table.batches(day)
            noted = {note for note in rewritten if note.rsplit("~", 1)[0] in held}
            seen = {unescaped(name) for name in self.rows.files.statuses(COVERED, f"dt={day}")}
            missing = (held - self.rows.batches(day) | noted) - seen
            missing = {name for name in missing if name.rsplit("~", 1)[0] != batch}
            if not missing:
                continue
            rows = self.table.scan_batches(day, {name.rsplit("~", 1)[0] for name in missing} | missing)
            bits = combined(self.placed(rows.select("id", "timestamp")).select("hour", "block", *WORDS))
            self.rows.write(bits, f"cover-{uuid.uuid4().hex}")
            for name in missing:
                self.rows.files.write("", COVERED, f"dt={day}", escaped(name))
            added += len(missing)
        return added

    def suspects(self, placed: DataFrame, days: list[str], batch: str) -> DataFrame:
        """The rows of ``placed`` whose id may be stored by another batch."""
        hours = [row["hour"] for row in placed.select("hour").distinct().limit(NAMED_HOURS + 1).collect()]
        stored = self.rows.scan_days([day for day in self.rows.days() if day in set(days)])
        if len(hours) <= NAMED_HOURS:
            stored = stored.where(F.col("hour").isin(hours))
        mine, theirs = placed.alias("mine"), stored.where(F.col("batch") != batch).alias("theirs")
        same = (F.col("mine.hour") == F.col("theirs.hour")) & (F.col("mine.block") == F.col("theirs.block"))
        for word in WORDS:
            same &= F.col(f"theirs.{word}").bitwiseAND(F.col(f"mine.{word}")) == F.col(f"mine.{word}")
        return mine.join(theirs, same, "left_semi")
