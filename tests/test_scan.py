"""Keys cut into ranges give what one window over the key gives."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from repolytics.operators import records, scan


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    found = [("hot" if rng.random() < 0.4 else rng.choice(["a", "b", None]), None if rng.random() < 0.02 else rng.randint(0, 300), i) for i in range(3000)]
    return spark.createDataFrame(found, "k string, t long, id long").repartition(4)


@pytest.mark.parametrize("most", [50, 10_000])
def test_numbers_and_previous_rows(rows, most):
    order = Window.partitionBy("k").orderBy(F.asc_nulls_first("t"), "id")
    expected = rows.select("id", F.row_number().over(order).alias("n"), F.lag("id").over(order).alias("p")).collect()
    got = {r.id: r.position for r in scan.numbered(rows, ["k"], "t", [F.asc("id")], most=most).collect()}
    assert got == {r.id: r.n for r in expected}
    got = scan.with_previous(rows, ["k"], "t", ["id"], F.col("id"), most=most)
    assert got.columns == ["k", "t", "id", "previous"]
    assert {r.id: r.previous for r in got.collect()} == {r.id: r.p for r in expected}


def test_ranges_of_a_hot_key_are_bounded(rows):
    found, several = scan.with_segments(rows, ["k"], "t", most=100)
    sizes = [r["count"] for r in found.filter("k = 'hot'").groupBy("segment").count().collect()]
    assert several and len(sizes) > 8 and max(sizes) < 250
    assert not scan.with_segments(rows.limit(0), ["k"], "t")[1]


def test_deltas_of_a_hot_project(spark):
    made = [("p" if i % 3 else "q", "health", i, f"2024-01-{1 + i % 28:02d}", f'{{"a": {i}, "b": {i * i}}}') for i in range(400)]
    df = spark.createDataFrame(made, "project_id string, analysis_type string, id long, created_at string, metrics_json string").withColumn("created_at", F.to_timestamp("created_at"))
    whole = {tuple(r) for r in records.snapshot_deltas(df).collect()}
    assert {tuple(r) for r in records.snapshot_deltas(df, most=40).collect()} == whole and len(whole) == 2 * 398
