"""The driver's tables read as tags, positions, reads, genes and cells, in Spark and in DuckDB."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UMI_LENGTH = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each countable read."""
    return raw_of(table(spark, sf_dir, "lineitem"))


def raw_of(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        (F.col("l_suppkey") % 10).cast("long").alias("barcode"),
        (F.col("l_partkey") % 50).cast("long").alias("gene"),
        (F.col("l_partkey") * 37 % 1024 * 4 + F.floor("l_quantity") % 3).cast("long").alias("umi"),
        F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("sample"),
        (F.col("l_linestatus") == "O").alias("random_hex"),
        F.element_at(F.create_map(*map(F.lit, ("A", "spliced", "N", "unspliced", "R", "ambiguous"))), F.col("l_returnflag")).alias("class"),
        F.col("l_suppkey").cast("long").alias("spot"),
    )


RAW_SQL = """SELECT l_suppkey % 10 AS barcode, l_partkey % 50 AS gene, ((l_partkey * 37) % 1024) * 4 + CAST(floor(l_quantity) AS BIGINT) % 3 AS umi,
  's' || (l_suppkey % 3) AS sample, l_linestatus = 'O' AS random_hex,
  CASE l_returnflag WHEN 'A' THEN 'spliced' WHEN 'N' THEN 'unspliced' ELSE 'ambiguous' END AS class, l_suppkey AS spot FROM lineitem"""


def tags(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    return collapsed(raw_tags(spark, sf_dir), *keys)


def collapsed(raw: DataFrame, *keys: str) -> DataFrame:
    return raw.groupBy("barcode", "gene", "umi", *keys).agg(*[F.count_if(F.col("class") == c).alias(c) for c in ("spliced", "unspliced", "ambiguous")])


def tags_sql(*keys: str) -> str:
    by = ", ".join(["barcode", "gene", "umi", *keys])
    return f"SELECT {by}, " + ", ".join(f"count(*) FILTER (class = '{c}') AS {c}" for c in ("spliced", "unspliced", "ambiguous")) + f" FROM raw GROUP BY {by}"


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of barcodes of the spatial variant: one for each supplier, in a grid of ten columns."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.cast("long").alias("barcode"), F.floor(key / 10).cast("long").alias("array_row"), (key % 10).cast("long").alias("array_col"), ((F.floor(key / 10) + key % 10) % 4 != 0).cast("long").alias("in_tissue")
    )


SPOTS_SQL = "SELECT s_suppkey AS barcode, s_suppkey // 10 AS array_row, s_suppkey % 10 AS array_col, CAST((s_suppkey // 10 + s_suppkey % 10) % 4 <> 0 AS BIGINT) AS in_tissue FROM supplier"
