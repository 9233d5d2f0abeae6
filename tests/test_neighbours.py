"""Neighbours by inverted lists against the exact ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cambium.operators import neighbours, stability


def table(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, vec array<double>").repartition(4)


@pytest.fixture(scope="module")
def clustered(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(0, 1, (40, 12))[draw.integers(0, 40, 1500)] * 3 + draw.normal(0, 1, (1500, 12))
    x[700:760] = x[700]  # a group of equal rows
    rows = table(spark, x).cache()
    return rows, stability.nearest(rows, 8).cache()


def test_recall(clustered):
    """A few of the lists are looked at, and nine of ten neighbours found."""
    rows, true = clustered
    index = neighbours.ListIndex(rows, 8, 0.93, list_rows=50)
    found = index.nearest().cache()
    assert index.probes < len(index.centres) / 2 and index.keys >= len(index.centres) == 30
    assert neighbours.recall_of(found, true).first()["recall"] >= 0.9
    assert found.groupBy("id").count().where("count > 8").count() == 0 and found.where("id = other").count() == 0


def test_all_lists_are_exact(clustered):
    rows, true = clustered
    found = neighbours.near_neighbours(rows, 8, probes=1000, list_rows=100)
    plain = lambda df: sorted((r["id"], r["place"], r["other"], round(r["d2"], 6)) for r in df.collect())
    assert plain(found) == plain(true)


def test_rows_are_dealt_once_a_block(spark, clustered):
    """Not once a list, nor all copies of a row compared; rows at no distance have no neighbours and are none."""
    rows, _ = clustered
    for found in (neighbours.near_neighbours(rows, 8, probes=1000, list_rows=100), stability.nearest(rows, 8)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "explode(lists" not in plan and "collect_list" not in plan
    x = np.random.default_rng(1).normal(0, 1, (500, 6)).round(1)
    x[100:400] = x[100]
    x[450] = np.nan
    ids, points = neighbours.enough(np.arange(500), x, 8)
    assert len(ids) == 500 - 1 - 300 + 9 and set(range(100, 109)) <= set(ids.tolist())
    found = {(r["id"], r["place"]): r["other"] for r in stability.nearest(table(spark, x), 8, block=90).collect()}
    for i in range(500):
        d = ((x[i] - x) ** 2).sum(1)
        want = [j for j in np.lexsort((np.arange(500), d)).tolist() if j != i and np.isfinite(d[j])][:8]
        assert [found.get((i, p)) for p in range(1, 9)] == (want or [None] * 8)


def test_rows_grow_with_the_input(clustered):
    """What is dealt out is rows times lists looked at, and the parts of long lists."""
    rows, _ = clustered
    index = neighbours.ListIndex(rows, 8, probes=3, list_rows=50)
    most = index.rows.groupBy("key").count().agg(F.max("count")).first()[0]
    assert most <= 3 * 2 * 50


def test_few_rows(spark, clustered):
    rows, _ = clustered
    assert neighbours.near_neighbours(rows.where("false"), 3).count() == 0
    assert neighbours.near_neighbours(rows.where("id = 1"), 3).count() == 0
    odd = rows.where("id < 3").unionByName(spark.createDataFrame([(None, [0.0] * 12), (9, None)], "id long, vec array<double>"))
    assert {(r["id"], r["place"]) for r in neighbours.near_neighbours(odd, 3).collect()} == {(i, p) for i in range(3) for p in (1, 2)}
