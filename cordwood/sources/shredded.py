"""Logs whose frequent attributes are columns of their own, the rest a map.

A filter on a map entry reads every map. The keys that many rows have, found by a heavy-hitter
sketch, get a column each, so that a filter on one is a comparison with file statistics and a
dictionary; rows come back with the whole map.
"""

from __future__ import annotations

import json
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cordwood.schema import ATTRIBUTES, LOG_COLUMNS, LOG_SCHEMA, PARTITION_FIELDS
from cordwood.sources.log_table import DayTable

# Columns at most, the share of rows a key must be in, and the items the sketch keeps.
MOST_KEYS, LEAST_SHARE, SKETCH_ITEMS = 16, 0.05, 10_000
KEYS = "_keys"


def frequent_keys(logs: DataFrame, most: int = MOST_KEYS, share: float = LEAST_SHARE) -> list[str]:
    """Attribute keys that are in at least about ``share`` of the rows, the most frequent first.

    One pass with a sketch of bounded size, whatever the number of keys.
    """
    keys = logs.select(F.explode(F.map_keys("attributes")).alias("key"))
    top = keys.agg(F.call_function("approx_top_k", F.col("key"), F.lit(most), F.lit(SKETCH_ITEMS)).alias("top"))
    rows = logs.count()
    found = top.select(F.inline("top")).collect()
    return [row["item"] for row in found if row["item"] is not None and row["count"] >= share * rows]


class ShreddedTable:
    """A log table with columns for some keys, which are settled when it is made."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str] | None = None) -> None:
        plain = [field for field in LOG_SCHEMA.fields if field.name != "attributes"]
        # Made without a schema first: the keys stand in a file of the table.
        files = DayTable(spark, path, LOG_SCHEMA, "timestamp").files
        if files.exists(KEYS):
            keys = json.loads(files.read(KEYS))
        else:
            files.write(json.dumps(keys or []), KEYS)
        self.keys = keys or []
        self.columns = {key: f"attribute_{place}" for place, key in enumerate(self.keys)}
        schema = T.StructType(
            [*plain, *(T.StructField(name, T.StringType()) for name in self.columns.values()), T.StructField("rest", ATTRIBUTES)]
        )
        self.rows = DayTable(spark, path, schema, "timestamp", ("timestamp", "id"))

    def write(self, logs: DataFrame, batch: str) -> None:
        own = [F.col("attributes")[key].alias(name) for key, name in self.columns.items()]
        rest = F.map_filter("attributes", lambda key, _: ~key.isin(self.keys)) if self.keys else F.col("attributes")
        plain = [name for name in LOG_COLUMNS if name != "attributes"]
        self.rows.write(logs.select(*plain, *own, rest.alias("rest")), batch)

    def _whole(self, stored: DataFrame) -> DataFrame:
        parts = [
            F.when(F.col(name).isNotNull(), F.create_map(F.lit(key), F.col(name))).otherwise(
                F.create_map().cast("map<string,string>")
            )
            for key, name in self.columns.items()
        ]
        whole = F.map_concat("rest", *parts) if parts else F.col("rest")
        partitions = [field.name for field in PARTITION_FIELDS]
        return stored.withColumn("attributes", whole).select(*LOG_COLUMNS, *partitions)

    def read(self) -> DataFrame:
        return self._whole(self.rows.read())

    def scan(
        self, attributes: dict[str, str], first: datetime | None = None, last: datetime | None = None
    ) -> DataFrame:
        """Rows of the days from ``first`` to ``last`` whose attributes have these values.

        A missing attribute reads as empty. Values of frequent keys are compared in the files.
        """
        wanted = [self._equals(key, value) for key, value in attributes.items()]
        rows = self.rows.scan(first, last)
        return self._whole(reduce(DataFrame.where, wanted, rows))

    def _equals(self, key: str, value: str) -> Column:
        column = F.col(self.columns[key]) if key in self.columns else F.col("rest")[key]
        return (column == value) | column.isNull() if value == "" else column == value
