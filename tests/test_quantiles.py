"""Stored quantile sketches and exact quantiles by narrowing."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest

from cordwood.operators import quantiles

START = datetime(2024, 1, 10, 8)


def samples(spark, values):
    rows = [(START + timedelta(seconds=i % 7200), key, value) for i, (key, value) in enumerate(values)]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, key string, value double")


@pytest.mark.parametrize("fraction", [0.0, 0.5, 0.95, 1.0])
def test_one_group_with_all_rows_is_narrowed_until_it_fits(spark, fraction):
    draw = np.random.default_rng(3)
    numbers = np.round(draw.lognormal(3, 2, 60_000), 3)
    rows = samples(spark, [(None, float(x)) for x in numbers]).persist()
    sketches = quantiles.quantile_sketches(rows, ["key"], "value")
    found = quantiles.brackets(rows, ["key"], "value", fraction, sketches, max_inside=100).collect()
    assert len(found) == 1 and found[0]["between"] <= 100
    exact = quantiles.exact_quantile(rows, ["key"], "value", fraction, sketches, max_inside=100).collect()
    assert exact[0]["quantile"] == pytest.approx(float(np.quantile(numbers, fraction)), rel=1e-12)
    rows.unpersist()


def test_groups_of_ties_few_rows_and_missing_values(spark):
    draw = random.Random(5)
    groups = {
        "same": [7.0] * 5000,
        "two": [1.0] * 4000 + [2.0] * 211,
        "one": [3.5],
        "pair": [1.0, 2.0],
        "mixed": [float(draw.choice([0, 0, 0, 5, 9, draw.random()])) for _ in range(3000)],
        None: [float("inf"), -1.0, 4.0],
    }
    values = [(key, value) for key, own in groups.items() for value in own]
    draw.shuffle(values)
    rows = samples(spark, values + [("nothing", None), ("one", float("nan"))])
    sketches = quantiles.quantile_sketches(rows, ["key"], "value")
    found = quantiles.exact_quantile(rows, ["key"], "value", 0.95, sketches, max_inside=50).collect()
    expected = {key: float(np.quantile(own, 0.95)) for key, own in groups.items() if key}
    assert {row["key"]: row["quantile"] for row in found if row["key"]} == pytest.approx(expected)
    assert {row["key"] for row in found} == set(groups)


def test_a_wrong_sketch_is_opened_again(spark):
    rows = samples(spark, [("a", float(i)) for i in range(3000)])
    off = quantiles.quantile_sketches(samples(spark, [("a", float(i - 9000)) for i in range(3000)]), ["key"], "value")
    found = quantiles.exact_quantile(rows, ["key"], "value", 0.95, off, max_inside=60).collect()
    assert found[0]["quantile"] == pytest.approx(np.quantile(range(3000), 0.95))


def test_stored_sketches_answer_any_range_and_merge(spark, tmp_path):
    draw = np.random.default_rng(8)
    table = quantiles.quantile_table(spark, str(tmp_path / "sketches"), ["key"])
    parts = [samples(spark, [("ab"[i % 2], float(x)) for i, x in enumerate(draw.normal(size=4000))]) for _ in range(3)]
    for number, part in enumerate(parts):
        table.write(quantiles.quantile_sketches(part, ["key"], "value"), f"{number}")
    rows = parts[0].union(parts[1]).union(parts[2])
    before = table.read().count()
    assert table.merge(date(2024, 2, 1)) == 3 and table.read().count() * 3 == before
    hour = START + timedelta(hours=1)
    wanted = rows.where(f"timestamp < timestamp_ntz '{hour}'")
    stored = table.read().where(f"start < timestamp_ntz '{hour}'")
    exact = {r["key"]: r["quantile"] for r in quantiles.exact_quantile(wanted, ["key"], "value", 0.95, stored).collect()}
    plain = {}
    for row in wanted.collect():
        plain.setdefault(row["key"], []).append(row["value"])
    assert exact == pytest.approx({key: float(np.quantile(own, 0.95)) for key, own in plain.items()})
    for row in quantiles.estimated_quantile(stored, ["key"], 0.95).collect():
        own = plain[row["key"]]
        assert row["rows"] == len(own)
        assert abs(sum(x <= row["quantile"] for x in own) / len(own) - 0.95) <= 2 * quantiles.MARGIN
