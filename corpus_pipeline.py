"""The corpus pipeline: toxicity, exact dedup, near dedup, decontamination and packing.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet
and read again as the next stage's docs. Null and empty texts pass all filters
but those of copies, of which one stays; other columns pass as they are,
whatever their names; an empty table gives an empty result. What a stage
returns is computed when it is written, so stages leave the session's limit of
batches set; run() puts it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.llm import decontaminate, exact_dedup, packing, shingle_dedup, simhash, toxicity
from cambium.llm.common import BATCH_SETTING, read, scratch, small_batches


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near by SimHash, as op5 has it, or by the shingles that its fingerprints can't tell: one row of what either links stays."""
    small_batches(spark)
    return shingle_dedup.drop_similar(docs, near=simhash.near_roots(docs))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that windows of the benchmark cover go, and documents that consist of them for the most part; n_chars, if there is one, follows."""
    small_batches(spark)
    cleaned = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: SQL can't express learning, SimHash or tokenising; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    limit = spark.conf.get(BATCH_SETTING, None)
    try:
        for number, (_, stage) in enumerate(STAGES):
            path = f"{folder}/{number}.parquet"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        if limit is None:
            spark.conf.unset(BATCH_SETTING)
    return docs
