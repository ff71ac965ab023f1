"""Distinct values of ranges by sketches, and frequent attributes as columns."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cordwood.operators import distinct
from cordwood.operators.filters import field_predicates, where_all
from cordwood.plans.params import ListingQuery
from cordwood.schema import LOG_SCHEMA
from cordwood.sources.shredded import ShreddedTable, frequent_keys

DAY = datetime(2024, 1, 10, 8)


@pytest.mark.parametrize("users", [300, 60_000])
def test_ranges_are_combined_within_the_bound(spark, tmp_path, users):
    rows = spark.range(users * 2).select(
        (F.lit(DAY).cast("timestamp_ntz") + F.expr("make_dt_interval(cast(id % 6 as int))")).alias("timestamp"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("service"),
        F.when(F.col("id") % 97 != 0, F.col("id") % users).alias("user"),
    )
    table = distinct.distinct_table(spark, str(tmp_path / "sketches"), ["service"])
    for number in range(2):
        table.write(distinct.distinct_sketches(rows.where(f"user % 2 = {number} or user is null"), ["service"], "user"), f"{number}")
    assert table.merge(date(2024, 1, 13)) > 0
    time = {"stored": F.col("start"), "rows": F.col("timestamp")}
    limits = [F.lit(DAY + timedelta(days=n)).cast("timestamp_ntz") for n in (2, 4)]
    limits = [F.date_trunc("day", limit).cast("timestamp_ntz") for limit in limits]
    ranges = {name: (column < limits[1], column >= limits[0]) for name, column in time.items()}
    found = {r["service"]: r for r in distinct.compared_ranges(table.read(), ["service"], *ranges["stored"]).collect()}
    exact = {r["service"]: r for r in distinct.exact_ranges(rows, ["service"], "user", *ranges["rows"]).collect()}
    assert found.keys() == exact.keys() == {"a", "b"}
    for service, row in exact.items():
        bound = found[service]["bound"]
        assert (bound == 0) == (users == 300)
        for name in ("in_first", "in_second", "in_either", "in_both", "only_first"):
            assert abs(found[service][name] - row[name]) <= bound, (name, bound)


def test_frequent_attributes_are_columns_that_filters_reach(spark, tmp_path):
    rows = []
    for i in range(200):
        attributes = {"region": f"r{i % 3}"} if i % 2 else {}
        attributes |= {"user": str(i % 7), f"rare{i}": "x"} | ({"empty": ""} if i % 5 == 0 else {})
        rows.append((f"{i}", DAY + timedelta(minutes=i), "info", "api", "m", attributes))
    logs = spark.createDataFrame(rows, LOG_SCHEMA)
    keys = frequent_keys(logs, most=3, share=0.2)
    assert set(keys) == {"user", "region", "empty"} and keys[0] == "user"
    table = ShreddedTable(spark, str(tmp_path / "logs"), keys)
    table.write(logs, "1")
    again = ShreddedTable(spark, str(tmp_path / "logs"))
    assert again.keys == keys

    def plain(df):
        return sorted((r["id"], sorted(r["attributes"].items())) for r in df.collect())

    assert plain(again.read()) == plain(logs)
    for wanted in ({"region": "r1"}, {"user": "3", "region": "r0"}, {"rare5": "x"}, {"region": ""}, {"empty": ""}, {"none": ""}, {"user": "none"}):
        asked = ListingQuery.parse({f"attr.{key}": value for key, value in wanted.items()})
        assert plain(again.scan(wanted)) == plain(where_all(logs, field_predicates(asked))), wanted
    plan = again.scan({"user": "3"})._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(attribute_0), EqualTo(attribute_0,3)]" in plan.replace("\n", "")
