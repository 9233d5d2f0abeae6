"""Values between the points of a curve, and as-of joins, over ranges of x that tasks have to themselves.

Points and places meet in buckets of about equal size; what a bucket needs of
its neighbours is the last point before it and the first after it, one row a
bucket, carried over empty buckets. No task sees the whole curve.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept

#: Rows of a bucket, about.
BUCKET = 200_000


def bucketed(rows: DataFrame, rows_of_bucket: int = BUCKET) -> DataFrame:
    """Adds `bucket`, a number that grows with x, by approximate quantiles."""
    count = max(1, -(-rows.count() // rows_of_bucket))
    edges = sorted(set(rows.approxQuantile("x", [i / count for i in range(1, count)], 0.25 / count))) if count > 1 else []
    splits = [-float("inf"), *[e for e in edges if abs(e) != float("inf")], float("inf")]
    return Bucketizer(splits=splits if len(splits) > 2 else [-float("inf"), 0.0, float("inf")], inputCol="x", outputCol="bucket").transform(rows)


def as_of(points: DataFrame, places: DataFrame, rows_of_bucket: int = BUCKET) -> DataFrame:
    """x, before and after for each distinct x of `places`: the last point (x, y) at or before it and the first after it, null where there is none.

    Of points with the same x the largest y counts. Nulls and NaN of x take no
    part; an empty curve has no points before or after; infinite places are
    places like any other.
    """
    real = F.col("x").isNotNull() & ~F.isnan("x")
    x = F.col("x").cast("double").alias("x")
    curve = points.select(x, F.col("y").cast("double").alias("y")).where(real & F.col("y").isNotNull()).groupBy("x").agg(F.max("y").alias("y"))
    both = curve.select("x", F.struct("x", "y").alias("point")).unionByName(places.select(x).where(real).distinct().select("x", F.lit(None).cast("struct<x:double,y:double>").alias("point")))
    placed = bucketed(kept(both), rows_of_bucket)
    edges = placed.groupBy("bucket").agg(F.max("point").alias("last"), F.min("point").alias("first"))  # one row a bucket
    # min and max of structs go by x and leave nulls out.
    # What follows is what came last in the other order: a frame that ends unbounded would be read again for each row.
    past = lambda order: order.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select("bucket", F.last("last", True).over(past(Window.orderBy("bucket"))).alias("earlier"), F.last("first", True).over(past(Window.orderBy(F.desc("bucket")))).alias("later"))
    by, place = Window.partitionBy("bucket"), F.col("point").isNull()
    near = placed.select("bucket", "x", "point", F.last("point", True).over(by.orderBy("x", place)).alias("before"), F.last("point", True).over(past(by.orderBy(F.desc("x"), place.desc()))).alias("after"))
    joined = near.where("point IS NULL").join(F.broadcast(edges), "bucket")
    return joined.select("x", F.coalesce("before", "earlier").alias("before"), F.coalesce("after", "later").alias("after"))


def interpolated(points: DataFrame, places: DataFrame, scale: Callable[[Column], Column] = F.log10, rows_of_bucket: int = BUCKET) -> DataFrame:
    """x and y for each distinct x of `places`: between two points a straight line over scale(x), at a point and after the last one its y, before the first null."""
    found = as_of(points, places, rows_of_bucket)
    at = scale(F.col("before.x"))
    share = (scale(F.col("x")) - at) / (scale(F.col("after.x")) - at)
    straight = F.col("before.y") + F.coalesce(share * (F.col("after.y") - F.col("before.y")), F.lit(0.0))
    return found.select("x", F.when(F.col("x") == F.col("before.x"), F.col("before.y")).otherwise(straight).alias("y"))
