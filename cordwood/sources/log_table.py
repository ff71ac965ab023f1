"""The stored tables: Parquet under dt=<day>/batch=<batch>, sorted by (timestamp, id).

Beside the days a table keeps folders of small files. ``_batches`` has one for each batch that was
begun, so that only a repeated write looks for what an earlier one left, and ``_rewritten`` one for
each such repetition. ``_merges`` has one for each merged folder, with the batches it stands for: a
merged folder counts from the moment this file is there, and the batches it names no more.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cordwood.functions.times import instant
from cordwood.operators.buckets import minute_rollup
from cordwood.operators.filters import day_predicates, where_all
from cordwood.schema import (
    LOG_SCHEMA,
    RECEIPT_SCHEMA,
    REJECT_SCHEMA,
    ROLLUP_SCHEMA,
    with_partitions,
)
from cordwood.session import plan_bytes
from cordwood.sources.files import Files

RETENTION = timedelta(days=30)

# Rows per file at most; the writer starts a new file beyond it.
MAX_RECORDS_PER_FILE = 20_000_000

# Input bytes per task of a bulk load, and the most tasks it asks for: beyond that they only grow.
LOAD_BYTES = 256 << 20
MAX_PARTITIONS = 100_000


# Bytes of a merged folder, and the share of them from which a batch is left as it is.
MERGE_BYTES, LARGE_SHARE = 256 << 20, 0.5
MERGED = "merged-"
BATCHES, MERGES, REWRITTEN = "_batches", "_merges", "_rewritten"

# Small tables of a store's batches that are not shown yet.
DRAFTS = "_drafts"

# The folder Spark gives to rows whose day is null.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def within_days(days: Sequence[str], first: datetime | None, last: datetime | None) -> list[str]:
    """The days from ``first`` to ``last``; ISO text sorts as the days do."""
    return [
        day
        for day in days
        if (first is None or day >= first.date().isoformat())
        and (last is None or day <= last.date().isoformat())
    ]


def escaped(name: str) -> str:
    """A partition value as Spark writes it into a folder name."""
    return "".join(f"%{ord(c):02X}" if c in '"#%\'*/:=?\\\x7f{}[]^' or c < " " else c for c in name)


def unescaped(name: str) -> str:
    """The partition value of a folder name."""
    parts = name.split("%")
    return parts[0] + "".join(chr(int(part[:2], 16)) + part[2:] for part in parts[1:])


def packed(sizes: dict[str, int], most: int) -> list[list[str]]:
    """Names in bins of at most ``most`` bytes, the largest first into the first bin with room."""
    bins: list[tuple[int, list[str]]] = []
    for name, size in sorted(sizes.items(), key=lambda item: (-item[1], item[0])):
        for place, (used, names) in enumerate(bins):
            if used + size <= most:
                names.append(name)
                bins[place] = (used + size, names)
                break
        else:
            bins.append((size, [name]))
    return [names for _, names in bins]


@dataclass(frozen=True)
class Merge:
    """A merged folder of one day and the batches it stands for, those merged twice included."""

    day: str
    name: str
    replaced: frozenset[str]
    written: datetime


class DayTable:
    """A Parquet table laid out by day and batch.

    A write replaces the batch: the folders of the days it has rows for, and those that an earlier
    write of the same batch left on other days. Writing a batch again therefore leaves one copy of
    it, which makes a sink that may be retried exact. Days are handled as ISO text, as the names of
    their folders: a year 0, which is legal, is no Python date.

    ``merge`` packs the small batches of closed days into few sorted folders. ``fold`` may reduce
    rows that come together there; it must keep the meaning of the rows and their columns.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        day_column: str,
        order: Sequence[str] = (),
        fold: Callable[[DataFrame], DataFrame] | None = None,
    ):
        self.spark, self.path, self.schema = spark, path, schema
        self.day_column, self.order, self.fold = day_column, list(order), fold
        self.files = Files(spark, path)

    def read(self) -> DataFrame:
        return self.scan()

    def scan(self, first: datetime | None = None, last: datetime | None = None) -> DataFrame:
        """Rows of the days from ``first`` to ``last``.

        Only the folders of those days are listed: a table keeps one folder per day and batch, and
        listing all of them would cost more than a query for an hour.
        """
        days = within_days(self.days(), first, last)
        if first is None and last is None and NO_DAY in self._day_folders():
            days = [*days, NO_DAY]
        return self.scan_days(days)

    def scan_days(self, days: Sequence[str]) -> DataFrame:
        """Rows of these days, which must have folders."""
        return self._read_folders([folder for day in days for folder in self._folders_of(day)])

    def _read_folders(self, folders: Sequence[str]) -> DataFrame:
        schema = with_partitions(self.schema)
        if not folders:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/{folder}" for folder in folders]
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*paths)

    def _folders_of(self, day: str) -> list[str]:
        """The folders that count: the whole day, or its batches if anything was ever merged."""
        if not self.files.exists(MERGES):
            return [f"dt={day}"]
        return [f"dt={day}/batch={escaped(batch)}" for batch in self.visible(day)]

    def _batch_names(self, day: str) -> list[str]:
        found = self.files.statuses(f"dt={day}")
        return [unescaped(name[6:]) for name in found if name.startswith("batch=")]

    def merges(self, day: str) -> list[Merge]:
        """The merged folders of a day that were finished, also those merged again since."""
        found = self.files.statuses(MERGES, f"dt={day}")
        return [
            Merge(
                day,
                name,
                frozenset(self.files.read(MERGES, f"dt={day}", name).splitlines()),
                datetime.fromtimestamp(status.getModificationTime() / 1000, timezone.utc).replace(tzinfo=None),
            )
            for name, status in found.items()
            if name.startswith(MERGED)
        ]

    def visible(self, day: str) -> list[str]:
        """The batches of a day that count: finished merges for what they replaced, and the rest."""
        # A merge that ends between the two listings shows its batches still.
        merges = self.merges(day)
        names = self._batch_names(day)
        finished = {merge.name for merge in merges}
        replaced = frozenset().union(*(merge.replaced for merge in merges))
        return sorted(
            name for name in names if name not in replaced and (not name.startswith(MERGED) or name in finished)
        )

    def batches(self, day: str) -> set[str]:
        """All batches whose rows a day holds, as they were written, merged or not."""
        names = set(self._batch_names(day)).union(*(merge.replaced for merge in self.merges(day)))
        return {name for name in names if not name.startswith(MERGED)}

    def scan_batches(self, day: str, batches: Collection[str]) -> DataFrame:
        """Rows of a day in the folders that hold any of these batches; a merged one holds others too."""
        merges = {merge.name: merge.replaced for merge in self.merges(day)}
        wanted = frozenset(batches)
        names = [name for name in self.visible(day) if name in wanted or merges.get(name, frozenset()) & wanted]
        return self._read_folders([f"dt={day}/batch={escaped(name)}" for name in names])

    def write(self, df: DataFrame, batch: str) -> None:
        """Write one batch in few files, however many tasks made it.

        The rebalance hint gathers each day and lets the adaptive planner split a day that is too
        big for one task, without the extra pass that sampling a range costs.
        """
        self._save(self._gathered(df, batch), batch)

    def _gathered(self, df: DataFrame, batch: str) -> DataFrame:
        return self._with_day(df, batch).hint("rebalance", "dt")

    def _with_day(self, df: DataFrame, batch: str) -> DataFrame:
        return df.selectExpr(*[f"`{name}`" for name in self.schema.fieldNames()], *self._partition(batch))

    def _partition(self, batch: str) -> list[str]:
        """SQL for the day and the batch of a row, with the name in bytes: it may hold any character."""
        return [f"to_date(`{self.day_column}`) AS dt", f"CAST(X'{batch.encode().hex()}' AS STRING) AS batch"]

    def _save(self, df: DataFrame, batch: str) -> None:
        before = self.begin(batch)
        self._write_folders(df)
        self.finish(before)

    def _write_folders(self, df: DataFrame) -> None:
        (
            df.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
            .partitionBy("dt", "batch")
            .parquet(self.path)
        )

    def begin(self, batch: str) -> dict[object, list[object]]:
        """Note that a batch is written; what an earlier write of it left, for ``finish``.

        Only a batch that was begun before is looked for in the days of the table.
        """
        if batch.startswith(MERGED):
            raise ValueError(f"{batch!r}: names of merged folders are not for batches")
        name = escaped(batch)
        known = self.files.exists(BATCHES, name)
        unnoted = not known and not self.files.exists(BATCHES) and bool(self._day_folders())
        if self.files.exists(BATCHES, f"{MERGED}{name}"):
            raise ValueError(f"batch {batch!r} has been merged with others and cannot be written again")
        if known:
            self.files.write("", REWRITTEN, f"{name}~{uuid.uuid4().hex}")
        else:
            self.files.write("", BATCHES, name)
        return self._batch_files(batch) if known or unnoted else {}

    def finish(self, before: dict[object, list[object]]) -> None:
        """Delete what an earlier write left and this one did not replace."""
        # A replaced folder has new files; one that still has a file of before was not replaced.
        _, fs = self._folder()
        for folder, files in before.items():
            if any(fs.exists(file) for file in files):
                fs.delete(folder, True)

    def merge(self, before: date, spare: Collection[str] = (), most: int = MERGE_BYTES) -> int:
        """Pack the small batches of the days before ``before`` into sorted folders; how many went in.

        Folders of up to ``most`` bytes are filled by size, one task each. Batches in ``spare`` stay as
        they are: a stream's last batch, which it may write again. All other batches that are merged
        cannot be written again. Readers see the batches until the merged folder is finished, and
        the merged folder from then on; ``sweep`` deletes the batches later. One merge of a table runs
        at a time.
        """
        plan, lists = [], {}
        for day in self.days():
            if day >= before.isoformat():
                continue
            merges = {merge.name: merge.replaced for merge in self.merges(day)}
            sizes = {
                batch: self.files.size(f"dt={day}", f"batch={escaped(batch)}")
                for batch in self.visible(day)
                if batch not in spare
            }
            small = {batch: size for batch, size in sizes.items() if size < most * LARGE_SHARE}
            for names in packed(small, most):
                if len(names) > 1:
                    merged = f"{MERGED}{uuid.uuid4().hex}"
                    plan += [(day, name, merged) for name in names]
                    lists[day, merged] = set(names).union(*(merges.get(name, ()) for name in names))
        if not plan:
            return 0
        # From here on readers name the folders that count.
        self.files.store.mkdirs(self.files.under(MERGES))
        self._write_folders(self._merged(plan))
        for (day, merged), names in lists.items():
            for name in names:
                if not name.startswith(MERGED):
                    self.files.write("", BATCHES, f"{MERGED}{escaped(name)}")
            self.files.write("\n".join(sorted(names)), MERGES, f"dt={day}", merged)
        return len(plan)

    def _merged(self, plan: list[tuple[str, str, str]]) -> DataFrame:
        """The rows of the batches in a plan (day, batch, merged name), in order."""
        rows = self._read_folders([f"dt={day}/batch={escaped(batch)}" for day, batch, _ in plan])
        # A row per folder of small batches.
        bins = self.spark.createDataFrame(plan, "day string, batch string, merged string")
        placed = (
            rows.withColumn("day", F.col("dt").cast("string"))
            .join(bins, ["day", "batch"])
            .drop("day", "batch")
            .withColumnRenamed("merged", "batch")
        )
        folded = self.fold(placed) if self.fold else placed
        gathered = folded.select(*self.schema.fieldNames(), "dt", "batch").hint("rebalance", "dt", "batch")
        return gathered.sortWithinPartitions("dt", "batch", *self.order)

    def sweep(self, now: datetime, grace: timedelta = timedelta(hours=1)) -> int:
        """Delete batches that were merged longer than ``grace`` ago; how many went.

        ``grace`` is how long a reader may go on with the files it has listed.
        """
        dropped = 0
        for day in self.days():
            merges = self.merges(day)
            old = frozenset().union(*(merge.replaced for merge in merges if merge.written <= now - grace))
            for name in old.intersection(self._batch_names(day)):
                self.files.delete(f"dt={day}", f"batch={escaped(name)}")
                dropped += 1
        return dropped

    def _batch_files(self, batch: str) -> dict[object, list[object]]:
        """The folders an earlier write of this batch left, with their files."""
        _, fs = self._folder()
        found = {}
        for day in self._day_folders().values():
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(day, f"batch={escaped(batch)}")
            if fs.exists(folder):
                files = (status.getPath() for status in fs.listStatus(folder))
                found[folder] = [file for file in files if file.getName().startswith("part-")]
        return found

    def _folder(self):
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        folder, fs = self._folder()
        return fs.exists(folder)

    def _day_folders(self) -> dict[str, object]:
        folder, fs = self._folder()
        if not fs.exists(folder):
            return {}
        names = ((status.getPath().getName(), status.getPath()) for status in fs.listStatus(folder))
        return {name[3:]: path for name, path in names if name.startswith("dt=")}

    def days(self) -> list[str]:
        """Days that have a folder: one listing of the table's top level, no file is read."""
        return sorted(day for day in self._day_folders() if day != NO_DAY)

    def drop_days_before(self, day: date) -> list[str]:
        """Delete whole days; nothing is rewritten. Rows without a day stay."""
        _, fs = self._folder()
        folders = self._day_folders()
        dropped = [found for found in self.days() if found < day.isoformat()]
        for found in dropped:
            fs.delete(folders[found], True)
            self.files.delete(MERGES, f"dt={found}")
        return dropped


class LogTable(DayTable):
    """The accepted logs. ``trigrams`` may be set to the ``TrigramIndex`` that searches shall use."""

    def __init__(self, spark: SparkSession, path: str):
        self.trigrams = None
        super().__init__(spark, path, LOG_SCHEMA, "timestamp", ("timestamp", "id"))

    def load(self, df: DataFrame, batch: str, partitions: int | None = None) -> None:
        """Bulk load: files that each cover a narrow span of time.

        Rows go out by range of (timestamp, id). A day with many rows gets many tasks, even one
        whose rows share a single timestamp, and the time range in each file's footer is tight,
        so a query for an hour skips the day's other files. Without ``partitions`` there are as
        many as the input's size asks for, and no fewer than the session's.
        """
        keys = ["dt", "timestamp", "id"]
        rows = self._with_day(df, batch)
        if partitions is None:
            needed = min(plan_bytes(df) // LOAD_BYTES, MAX_PARTITIONS)
            if int(self.spark.conf.get("spark.sql.shuffle.partitions")) < needed:
                partitions = needed
        spread = (
            rows.repartitionByRange(*keys)
            if partitions is None
            else rows.repartitionByRange(partitions, *keys)
        )
        self._save(spread.sortWithinPartitions(*keys), batch)

    def append(self, df: DataFrame, batch: str, gathered: bool = False) -> None:
        """Write one micro-batch, whose rows mostly lie close in time already, in sorted files.

        ``gathered`` rows lie together as they shall be written.
        """
        keys = ["dt", "timestamp", "id"]
        rows = self._with_day(df, batch) if gathered else self._gathered(df, batch)
        self._save(rows.sortWithinPartitions(*keys), batch)

    def expire(self, now: datetime, keep: timedelta = RETENTION) -> list[str]:
        """Drop the days that lie wholly before the retention limit."""
        return self.drop_days_before((now - keep).date())


def retained(df: DataFrame, now: datetime, keep: timedelta = RETENTION) -> DataFrame:
    """Rows inside the retention limit, to the millisecond."""
    limit = now - keep
    predicates = [F.col("timestamp") >= instant(limit)]
    if "dt" in df.columns:
        predicates += day_predicates(limit, None)
    return where_all(df, predicates)


def _merged_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("dt", "batch", "start", "service", "level").agg(F.sum("count").alias("count"))


class LogStore:
    """The four tables one ingest writes, under one root: the logs, and three small ones beside them.

    The small ones share a folder by kind, so that one job writes all three.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)
        self.logs = LogTable(spark, f"{self.root}/logs")
        self.side = f"{self.root}/side"
        self.rollup = DayTable(spark, f"{self.side}/kind=rollup", ROLLUP_SCHEMA, "start", ("start",), _merged_counts)
        self.rejects = DayTable(spark, f"{self.side}/kind=rejects", REJECT_SCHEMA, "received_at", ("received_at",))
        self.receipts = DayTable(spark, f"{self.side}/kind=receipts", RECEIPT_SCHEMA, "received_at", ("received_at",))

    def load(self, df: DataFrame, batch: str) -> None:
        """Bulk load that keeps the rollup in step; loading a batch again replaces it."""
        self.logs.load(df, batch)
        # From the stored rows: three columns to read, where ``df`` may be costly to work out again.
        stored = self.logs.read().where(F.col("batch") == batch)
        self.rollup.write(minute_rollup(stored), batch)

    def write_side(self, batch: str, rollup: DataFrame, rejects: DataFrame, receipts: DataFrame) -> None:
        """Write a batch of the three small tables in one job, as ``DayTable.write`` does for one."""
        before = self.begin_side(batch)
        rows = self._side_rows(batch, rollup, rejects, receipts)
        self._side_writer(rows.hint("rebalance", "kind", "dt")).option("partitionOverwriteMode", "dynamic").parquet(self.side)
        self._finish_side(before)

    def draft_side(self, batch: str, rollup: DataFrame, rejects: DataFrame, receipts: DataFrame) -> None:
        """The same for few rows that lie together already, but out of sight until ``show_side``."""
        self._side_writer(self._side_rows(batch, rollup, rejects, receipts)).parquet(f"{self.root}/{DRAFTS}/{escaped(batch)}")

    def show_side(self, batch: str, before: list) -> None:
        """Put the draft of a batch in its place: the receipts last, which say that the rest is there.

        ``before`` is what ``begin_side`` gave.
        """
        draft, folder = (DRAFTS, escaped(batch)), f"batch={escaped(batch)}"
        for kind, table in self._side_tables().items():
            for day in self.files.statuses(*draft, f"kind={kind}"):
                table.files.store.mkdirs(table.files.under(day))
                table.files.delete(day, folder)
                drafted = self.files.under(*draft, f"kind={kind}", day, folder)
                if not self.files.store.rename(drafted, table.files.under(day, folder)):
                    raise OSError(f"cannot show {drafted}")
        self._finish_side(before)
        self.files.delete(*draft)

    def _side_tables(self) -> dict[str, DayTable]:
        return {"rollup": self.rollup, "rejects": self.rejects, "receipts": self.receipts}

    def _side_rows(self, batch: str, *parts: DataFrame) -> DataFrame:
        """The rows of the small tables together, each with the columns of all."""
        tables = self._side_tables()
        types = {field.name: field.dataType.simpleString() for table in tables.values() for field in table.schema}
        rows = None
        for (kind, table), df in zip(tables.items(), parts, strict=True):
            own = set(table.schema.fieldNames())
            columns = [f"`{name}`" if name in own else f"CAST(NULL AS {type}) AS `{name}`" for name, type in types.items()]
            part = df.selectExpr(*columns, *table._partition(batch), f"'{kind}' AS kind")
            rows = part if rows is None else rows.union(part)
        return rows

    def _side_writer(self, rows: DataFrame) -> DataFrameWriter:
        writer = rows.write.mode("overwrite").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        return writer.partitionBy("kind", "dt", "batch")

    def begin_side(self, batch: str) -> list[tuple[DayTable, dict[object, list[object]]]]:
        """Note that a batch of the small tables is written; what earlier writes of it left."""
        return [(table, table.begin(batch)) for table in self._side_tables().values()]

    def _finish_side(self, before: list[tuple[DayTable, dict[object, list[object]]]]) -> None:
        for table, files in before:
            table.finish(files)

    def merge(self, before: date, spare: Collection[str] = ()) -> int:
        """Merge the small batches of closed days in all tables; see ``DayTable.merge``."""
        return sum(table.merge(before, spare) for table in (self.logs, self.rollup, self.rejects, self.receipts))

    def sweep(self, now: datetime, grace: timedelta = timedelta(hours=1)) -> int:
        """Delete what was merged longer than ``grace`` ago."""
        return sum(table.sweep(now, grace) for table in (self.logs, self.rollup, self.rejects, self.receipts))

    def expire(self, now: datetime, keep: timedelta = RETENTION) -> list[str]:
        """Drop the days past the limit from all tables; the days dropped from the logs."""
        limit = (now - keep).date()
        for table in (self.rollup, self.rejects, self.receipts):
            table.drop_days_before(limit)
        return self.logs.drop_days_before(limit)
