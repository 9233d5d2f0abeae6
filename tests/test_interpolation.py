"""Interpolation and as-of joins against numpy, with buckets of a few rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cambium.operators import interpolation


@pytest.mark.parametrize("size", [5, 40, 10**6])
def test_against_numpy(spark, size):
    rng = random.Random(3)
    curve = sorted({rng.randrange(10, 2000): None for _ in range(60)})
    points = [(float(x), float(rng.randrange(1000))) for x in curve]
    asked = [float(rng.randrange(1, 2500)) for _ in range(400)] + [points[0][0], points[-1][0]] + [55.5] * 200
    made = spark.createDataFrame([*points, (None, 1.0), (float("nan"), 2.0), (7.0, None)], "x double, y double").repartition(3)
    found = interpolation.interpolated(made, spark.createDataFrame([(x,) for x in [*asked, None, float("nan")]], "x double").repartition(4), rows_of_bucket=size)
    got = {r["x"]: r["y"] for r in found.collect()}
    assert set(got) == set(asked)
    x, y = np.asarray(points).T
    for at, value in got.items():
        assert value is None if at < x[0] else value == pytest.approx(np.interp(np.log10(at), np.log10(x), y))


def test_sparse_points_are_carried_over(spark):
    """Two points far apart, and many places between them that fill many buckets."""
    points = spark.createDataFrame([(0.0, 10.0), (1000.0, 20.0), (1000.0, 15.0)], "x double, y double")
    places = spark.range(1, 1000).select(F.col("id").cast("double").alias("x"))
    found = interpolation.as_of(points, places, 20).collect()
    assert len(found) == 999 and {(r["before"]["x"], r["after"]["x"], r["after"]["y"]) for r in found} == {(0.0, 1000.0, 20.0)}
    assert interpolation.interpolated(points, places, lambda x: x, 20).where("abs(y - 10 - x / 100) > 1e-9").count() == 0
    none = interpolation.as_of(points.where("false"), places, 20)
    assert none.where("before IS NULL AND after IS NULL").count() == 999
    assert interpolation.as_of(points, places.where("false")).count() == 0


def test_time_grows_with_the_rows_of_a_bucket(spark):
    """No window frame ends unbounded, for Spark reads such a frame again for each of its rows."""
    places = spark.range(4000).select(F.col("id").cast("double").alias("x"))
    points = spark.range(0, 4000, 9).select(F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    found = interpolation.as_of(points, places)
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString()
    for r in found.collect():
        last = r["x"] // 9 * 9
        assert r["before"]["x"] == last and (r["after"] is None if last + 9 >= 4000 else r["after"]["x"] == last + 9)


def test_no_task_has_all_rows(spark):
    places = spark.range(2000).select(F.col("id").cast("double").alias("x"))
    points = spark.range(0, 2000, 7).select(F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    most = interpolation.bucketed(points.select("x").unionByName(places), 100).groupBy("bucket").count().agg(F.max("count")).first()[0]
    assert most < 400


def test_numbers_are_dense(spark):
    from cambium.operators import numbering

    rng = random.Random(6)
    keys = rng.sample(range(10**6), 500)
    rows = spark.createDataFrame([(k, str(k)) for k in keys], "k long, name string").repartition(7)
    found = numbering.numbered(rows, ["k"])
    assert [r["number"] for r in found.orderBy("k").collect()] == list(range(500))
    again = numbering.numbered(rows.repartition(2), [F.desc("name")]).collect()
    assert [r["name"] for r in sorted(again, key=lambda r: r["number"])] == sorted(map(str, keys), reverse=True)
    assert numbering.numbered(rows.where("false"), ["k"]).count() == 0
