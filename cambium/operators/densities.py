"""What plots of distributions show, as tables: smoothed densities and two-way histograms on a grid of bounded size."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_bins(column: str, low: float, high: float, bins: int):
    """Bins 0 ... bins - 1 of equal width; values outside go to the first or last one."""
    return F.least(F.greatest(F.floor((F.col(column) - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1)).cast("long")


def histogram2d(rows: DataFrame, x: str, y: str, ranges: tuple[float, float, float, float], bins: int) -> DataFrame:
    x0, x1, y0, y1 = ranges
    return rows.groupBy(in_bins(x, x0, x1, bins).alias("x_bin"), in_bins(y, y0, y1, bins).alias("y_bin")).agg(F.count(F.lit(1)).alias("n"))


def density(rows: DataFrame, column: str, low: float, high: float, bins: int = 100, width: float = 2.0) -> DataFrame:
    """bin, at (its middle) and density: the histogram smoothed with a Gaussian of `width` bins, cut at four of them; sums to 1 but for the ends."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(in_bins(column, low, high, bins).alias("from")).agg(F.count(F.lit(1)).alias("n"))
    reach = int(4 * width)
    kernel = F.exp(-F.pow((F.col("bin") - F.col("from")) / width, F.lit(2)) / 2)
    spread = counts.withColumn("bin", F.explode(F.sequence(F.col("from") - reach, F.col("from") + reach))).withColumn("w", kernel)
    norm = sum(2.718281828459045 ** (-((i / width) ** 2) / 2) for i in range(-reach, reach + 1))
    step = (high - low) / bins
    found = spread.where(F.col("bin").between(0, bins - 1)).groupBy("bin").agg(F.sum(F.col("n") * F.col("w")).alias("mass"))
    whole = counts.agg(F.sum("n").alias("whole"))  # one row
    return found.crossJoin(F.broadcast(whole)).select("bin", (low + (F.col("bin") + 0.5) * step).alias("at"), (F.col("mass") / (F.col("whole") * norm * step)).alias("density"))
