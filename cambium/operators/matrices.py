"""Sparse matrices in compressed rows, written by tasks: nothing of a matrix is in the driver.

Entries are numbered in the order of rows and columns over range partitions, so
a row starts at the number of its first entry; rows without entries start where
the next ones do. The parts are Parquet tables that a reader puts side by side:
`rows` (row_number, the row's key, start, n), `columns` (column_number, key) and
`entries` (position, row_number, column_number, value).
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept
from .numbering import numbered, part_starts


@dataclass
class Compressed:
    rows: DataFrame
    columns: DataFrame
    entries: DataFrame

    def write(self, prefix: str) -> None:
        """Parquet folders under the prefix; entries keep their order within and between files."""
        self.rows.write.mode("overwrite").parquet(f"{prefix}_rows.parquet")
        self.columns.write.mode("overwrite").parquet(f"{prefix}_columns.parquet")
        self.entries.repartitionByRange("position").sortWithinPartitions("position").write.mode("overwrite").parquet(f"{prefix}_entries.parquet")


def compressed(entries: DataFrame, row: str = "barcode", column: str = "gene", value: str = "value", rows: DataFrame | None = None, columns: DataFrame | None = None) -> Compressed:
    """The matrix of (row, column, value). `rows` and `columns` name all keys there are, in order of which they are numbered; None: those that have entries.

    Entries of the same place add up; those of keys that aren't named are left
    out; keys are unique after that. An empty matrix has rows without entries.
    """
    row_keys = numbered((rows if rows is not None else entries).select(row).distinct(), [row], "row_number")
    column_keys = kept(numbered((columns if columns is not None else entries).select(column).distinct(), [column], "column_number"))
    row_keys = kept(row_keys)
    sums = entries.groupBy(row, column).agg(F.sum(value).alias("value"))
    placed = kept(numbered(sums.join(row_keys, row).join(column_keys, column).select("row_number", "column_number", "value"), ["row_number", "column_number"], "position"))
    lengths = placed.groupBy("row_number").agg(F.count(F.lit(1)).alias("n"))
    return Compressed(kept(with_starts(row_keys.join(lengths, "row_number", "left").fillna(0, ["n"]))), column_keys, placed)


def with_starts(rows: DataFrame) -> DataFrame:
    """Adds start, the sum of n over the rows before by row_number: sums inside range partitions, and one row a partition beside them."""
    placed, part, starts = part_starts(rows, ["row_number"], "n")
    inside = F.sum("n").over(Window.partitionBy("__part").orderBy("row_number")) - F.col("n")
    return placed.withColumn("__part", part).withColumn("start", inside).join(F.broadcast(starts), "__part").withColumn("start", F.col("start") + F.col("__start")).drop("__part", "__start", "__at")


def from_sample(matrices: DataFrame, seed: int, frac_idx: int, kind: str | None = None, rows: DataFrame | None = None, columns: DataFrame | None = None) -> Compressed:
    """The matrix of one seed and fraction (and class) of total_matrix or class_matrices."""
    chosen = matrices.where((F.col("seed") == seed) & (F.col("frac_idx") == frac_idx))
    if kind is not None:
        chosen = chosen.where(F.col("class") == kind)
    return compressed(chosen, rows=rows, columns=columns)
