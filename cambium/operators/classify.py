"""The status of each read: of the tests in order, the first that fails decides."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import encode

STATUSES = ("bad_tags", "low_quality", "countable")


def read_status(reads: DataFrame, umi_length: int, barcode_pattern: str, least_quality: int = 255) -> DataFrame:
    """Adds umi_code and status; a read without, or with malformed, barcode or UMI has bad tags."""
    code = encode(F.col("umi"))
    bad = F.col("cb").isNull() | F.col("umi").isNull() | (F.length("umi") != umi_length) | ~F.col("cb").rlike(f"^(?:{barcode_pattern})$") | code.isNull()
    low = F.col("chrom").isNull() | (F.col("flag").bitwiseAND(F.lit(4)) != 0) | (F.col("mapq") < least_quality)
    return reads.withColumn("umi_code", code).withColumn("status", F.when(bad, "bad_tags").when(low, "low_quality").otherwise("countable"))


def read_summary(judged: DataFrame, primers: bool = False, sample: str | None = None) -> DataFrame:
    """key, type and value: reads of each status, with `primers` those of each primer too; with `sample`, a column, of each sample, whose name the keys begin with.

    All keys are there for each sample that has reads. A read without sample is left out, one of an unknown primer counts for neither.
    """
    tests = {"total_reads": F.lit(True)} | {s: F.col("status") == s for s in (*STATUSES, "no_gene")}
    whose = {"": F.lit(True)} | ({"polyA_": ~F.col("random_hex"), "random_hex_": F.col("random_hex")} if primers else {})
    names = [f"{w}{t}" for w in whose for t in tests]
    counts = [F.count_if(a & b).alias(f"{w}{t}") for w, a in whose.items() for t, b in tests.items()]
    if sample is None:
        return judged.agg(*counts).unpivot([], names, "key", "value").select("key", F.lit("reads").alias("type"), F.col("value").cast("string").alias("value"))
    by = judged.where(F.col(sample).isNotNull()).groupBy(F.col(sample).alias("__sample")).agg(*counts).unpivot(["__sample"], names, "key", "value")
    return by.select(F.concat_ws("_", "__sample", "key").alias("key"), F.lit("reads").alias("type"), F.col("value").cast("string").alias("value"))
