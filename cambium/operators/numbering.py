"""Dense numbers in an order, over all partitions."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept

#: Bits of monotonically_increasing_id that count rows inside a partition.
INSIDE = 33


def part_starts(rows: DataFrame, order: list[Column | str], amount: str | None = None) -> tuple[DataFrame, Column, DataFrame]:
    """The rows dealt by ranges of the order, sorted and written; the column that tells their partition; and of each partition (__part) the number of rows, or sum of `amount`, in those before (__start)."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = kept(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", INSIDE)
    sizes = placed.groupBy(part.alias("__part")).agg((F.sum(amount) if amount else F.count(F.lit(1))).alias("__n"))
    starts = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))  # one row a partition
    return placed, part, starts


def numbered(rows: DataFrame, order: list[Column | str], into: str = "number") -> DataFrame:
    """Adds numbers from 0 without gaps, by `order`, which must tell all rows apart for reruns to agree.

    Rows are dealt by ranges of the order, sorted there and written, so places
    inside a partition can't change; each partition then starts at the number of
    rows in those before it. One shuffle, and one row a partition beside it.
    """
    placed, part, starts = part_starts(rows, order)
    inside = F.col("__at") - F.shiftleft(part, INSIDE)
    return placed.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn(into, F.col("__start") + inside).drop("__at", "__part", "__start")
