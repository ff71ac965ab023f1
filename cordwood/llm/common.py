"""Inputs, scratch tables and small column helpers that the operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cordwood.session import shared_dir

# A side of a join is broadcast only after it was counted and found to have at most so many rows;
# each such row holds one or two numbers. Larger sides are shuffled.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows no label may be learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    remainder = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3
    return F.coalesce(remainder == 1, F.lit(False))


def maybe_broadcast(side: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side


def set_apart(docs: DataFrame, *needed: str) -> DataFrame:
    """``docs`` with all other columns under names that clash with none; by place, so any name will do."""
    taken: set[str] = set()
    names = []
    for place, name in enumerate(docs.columns):
        own = name in needed and name not in taken
        taken.add(name)
        names.append(name if own else f"_column_{place}")
    return docs.toDF(*names)


def put_back(rows: DataFrame, docs: DataFrame, *needed: str) -> DataFrame:
    """The columns of ``docs`` under their own names, from rows of ``set_apart`` with more columns."""
    names = set_apart(docs, *needed).columns
    return rows.select(*(F.col(f"`{name}`") for name in names)).toDF(*docs.columns)


def making_room(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` with every column that has one of these names called ``<name>_before`` instead."""
    taken = {name.lower() for name in (*docs.columns, *names)}
    free = []
    for column in docs.columns:
        if column.lower() in names:
            column = f"{column}_before"
            while column.lower() in taken:
                column += "_"
            taken.add(column.lower())
        free.append(column)
    return docs.toDF(*free)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow, handing freed memory back when the task ends: workers outlive tasks."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return tidied


def bounded(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """A batch in parts of so many rows, so that what is made of it stays small on both sides."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


class Scratch:
    """Tables of one operator run in the shared folder; ``drop`` deletes those no longer needed."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """Write a frame and read it back, so that its lineage ends here."""
        df.write.parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
