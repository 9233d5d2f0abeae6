"""Cell filters and false discovery rates."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mad_filter(cells: DataFrame, least: int, mads: float, count_col: str = "molecules") -> DataFrame:
    """Adds `passed`: called, with at least `least` molecules and, on the logarithmic scale, at most `mads` median absolute deviations below the median of those."""
    used = cells.where((F.col("is_cell") > 0) & (F.col(count_col) >= least) & (F.col(count_col) > 0))
    middle = used.agg(F.median(F.log10(count_col)).alias("med"))
    spread = used.crossJoin(F.broadcast(middle)).agg(F.first("med").alias("med"), F.median(F.abs(F.log10(count_col) - F.col("med"))).alias("mad"))  # one row
    low = F.greatest(F.lit(float(least)), F.pow(F.lit(10.0), F.col("med") - mads * F.col("mad")))
    return cells.crossJoin(F.broadcast(spread)).withColumn("passed", ((F.col("is_cell") > 0) & F.coalesce(F.col(count_col) >= low, F.lit(False))).cast("int")).drop("med", "mad")


def benjamini_hochberg(tests: DataFrame, buckets: int = 1000) -> DataFrame:
    """Adds fdr to rows with p in [0, 1]: p n / rank, at most that of any larger p.

    Ranks of equal p, and minima from above, are taken over the distinct values,
    bucket by bucket, with totals carried over from the buckets themselves.
    """
    values = tests.groupBy("p").agg(F.count(F.lit(1)).alias("k")).withColumn("bucket", F.floor(F.col("p") * buckets))
    tops = values.groupBy("bucket").agg(F.sum("k").alias("in_bucket"))
    ordered = Window.orderBy("bucket")  # at most `buckets` + 1 rows
    tops = tops.withColumn("before", F.sum("in_bucket").over(ordered) - F.col("in_bucket")).withColumn("n", F.sum("in_bucket").over(Window.partitionBy()))
    up = Window.partitionBy("bucket").orderBy("p")
    ranked = values.join(F.broadcast(tops), "bucket").withColumn("q", F.col("p") * F.col("n") / (F.sum("k").over(up) + F.col("before")))
    least = ranked.groupBy("bucket").agg(F.min("q").alias("q"))
    after = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    least = least.select("bucket", F.coalesce(F.min("q").over(after), F.lit(1.0)).alias("above"))
    down = Window.partitionBy("bucket").orderBy(F.desc("p"))
    found = ranked.join(F.broadcast(least), "bucket").select("p", F.least(F.min("q").over(down), "above", F.lit(1.0)).alias("fdr"))
    return tests.join(found, "p")
