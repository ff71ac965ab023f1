"""Which files can hold a text: a bitmap of the trigrams of each file's messages.

A search for a text needs the trigrams of the pattern's fixed parts in one message, so a file without
one of them need not be opened. Signatures are stored beside the table by day; files that have none
yet are always read. Nothing is left out of a result: what is read is filtered as ever.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cordwood.functions.text import search_pattern
from cordwood.schema import with_partitions
from cordwood.sources.log_table import DayTable, LogTable, escaped

# Bits of a signature; they are stored in parts of 32,768, Spark's size of a bitmap.
BITS = 1 << 18

SIGNATURE_SCHEMA = T.StructType(
    [
        T.StructField("day", T.TimestampNTZType()),
        T.StructField("file", T.StringType()),
        T.StructField("part", T.LongType()),
        T.StructField("bits", T.BinaryType()),
    ]
)


def trigrams(text: Column) -> Column:
    """All runs of three characters of a text in lower case, as LIKE without case compares it."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?s)(?=(...))"), F.lit(1))


def _position(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(BITS))


def fixed_parts(like: str) -> list[str]:
    """The parts of a LIKE pattern that stand for themselves."""
    parts, part = [], ""
    for escape, plain in re.findall(r"\\(.)|(.)", like, re.S):
        if plain in ("%", "_"):
            parts, part = [*parts, part], ""
        else:
            part += escape or plain
    return [part for part in [*parts, part] if part]


class TrigramIndex:
    """The signatures of one log table, in the folder ``<table>-trigrams``."""

    def __init__(self, spark: SparkSession, table: LogTable) -> None:
        self.spark, self.table = spark, table
        self.rows = DayTable(spark, f"{table.path}-trigrams", SIGNATURE_SCHEMA, "day", ("file", "part"))

    def files(self, days: Sequence[str]) -> list[str]:
        """The files of some days that count, named from the table's folder."""
        return [
            f"dt={day}/batch={escaped(batch)}/{name}"
            for day in days
            for batch in self.table.visible(day)
            for name in self.table.files.statuses(f"dt={day}", f"batch={escaped(batch)}")
            if name.startswith("part-")
        ]

    def cover(self, days: Sequence[str]) -> int:
        """Store the signatures of files that have none; how many. Best done once days are merged."""
        known = {row["file"] for row in self._stored(days).select("file").distinct().collect()}
        missing = [file for file in self.files(days) if file not in known]
        if missing:
            # From the day's folder on, the path of a file is its name in the index; here it is a URI's.
            spoken = F.regexp_extract("_metadata.file_path", r"(dt=[^/]*/batch=[^/]*/[^/]*)$", 1)
            name = F.url_decode(F.replace(spoken, F.lit("+"), F.lit("%2B")))
            messages = self._read(missing).select("dt", "message", name.alias("file"))
            spelled = messages.select("dt", "file", F.explode_outer(F.array_distinct(trigrams(F.col("message")))).alias("trigram"))
            # Once per file first: far fewer rows reach the bitmaps. A file of short texts has an empty part 0.
            places = spelled.select("dt", "file", F.coalesce(_position(F.col("trigram")), F.lit(-1)).alias("at")).distinct()
            signed = places.groupBy("dt", "file", F.bitmap_bucket_number("at").alias("part")).agg(
                F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")
            )
            self.rows.write(signed.withColumn("day", F.col("dt").cast("timestamp_ntz")), f"index-{uuid.uuid4().hex}")
        return len(missing)

    def _stored(self, days: Sequence[str]) -> DataFrame:
        wanted = set(days)
        return self.rows.scan_days([day for day in self.rows.days() if day in wanted])

    def _read(self, files: Sequence[str]) -> DataFrame:
        schema = with_partitions(self.table.schema)
        if not files:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.table.path}/{file}" for file in files]
        return self.spark.read.schema(schema).option("basePath", self.table.path).parquet(*paths)

    def needed(self, q: str, mode: str = "wildcard") -> dict[int, list[int]]:
        """Part of the signature to the bits that a file must have set there."""
        # Lower case first, as a whole, as the comparison does it.
        one = self.spark.range(1)
        like = one.select(F.lower(F.lit(search_pattern(q, mode))).alias("like")).first()["like"]
        parts = fixed_parts(like)
        if not parts:
            return {}
        at = F.explode(F.array_distinct(F.flatten(F.array(*(trigrams(F.lit(part)) for part in parts)))))
        places = one.select(at.alias("trigram")).select(_position(F.col("trigram")).alias("at"))
        found: dict[int, list[int]] = {}
        for row in places.select(F.bitmap_bucket_number("at").alias("part"), F.bitmap_bit_position("at").alias("bit")).collect():
            found.setdefault(row["part"], []).append(row["bit"])
        return found

    def candidates(self, days: Sequence[str], q: str, mode: str = "wildcard") -> list[str]:
        """The files of some days that can hold a match: those with all bits, and those without a signature."""
        files, needed = self.files(days), self.needed(q, mode)
        if not needed:
            return files
        stored = self._stored(days)
        whole = F.lit(False)
        for part, bits in needed.items():
            has = F.col("part") == part
            for bit in bits:
                byte = F.conv(F.hex(F.substring("bits", bit // 8 + 1, 1)), 16, 10).cast("int")
                has &= F.shiftright(byte, bit % 8).bitwiseAND(1) == 1
            whole |= has
        rated = stored.groupBy("file").agg(F.count_if(whole).alias("parts")).collect()
        lacking = {row["file"] for row in rated if row["parts"] < len(needed)}
        return [file for file in files if file not in lacking]

    def scan_days(self, days: Sequence[str], q: str, mode: str = "wildcard") -> DataFrame:
        """Rows of some days in the files that can hold a match; not filtered yet."""
        return self._read(self.candidates(days, q, mode))
