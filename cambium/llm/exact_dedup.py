"""Exact de-duplication with a heavy-hitter split, in DataFrame functions only.

Frequent digests are found with Spark's frequent-items aggregate (the
Misra-Gries summary), counted exactly, and the verified ones broadcast, so the
rows of very large groups of copies never meet in one task. The other digests
have at most `support` of all rows each and go through an ordinary shuffle:
they are aggregated, and the rows joined with the aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, keep_rows, lower_az, read

#: A digest with more than this share of the rows is a heavy hitter, so at most 1 / SUPPORT digests are broadcast.
SUPPORT = 0.001


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, doc_id, digest (SHA-256 of the text with A-Z lower-cased, null as empty) and raw_hash of each row, written once."""
    return cut(
        docs.select(
            F.monotonically_increasing_id().alias("row_id"),
            F.col(id_col).alias("doc_id"),
            F.sha2(lower_az(F.coalesce(F.col(text_col), F.lit(""))), 256).alias("digest"),
            F.xxhash64(text_col).alias("raw_hash"),
        )
    )


def heavy_winners(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """digest, keep (doc_id and row_id of the row that stays) and group_size of each digest with more than `support` of the rows; at most 1 / support rows."""
    total = rows.count()
    candidates = rows.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    counted = (
        rows.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "row_id")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    )
    return cut(counted.where(F.col("group_size") > support * total))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, row_id, raw_hash.

    Texts are equal when identical after lower-casing A-Z only; null counts as
    empty. The row with the largest doc_id of a group stays; null ids sort
    below all others, and of rows with the same id one stays. An empty table
    gives an empty result; other columns of `docs` are never read.
    """
    rows = digests(docs, id_col, text_col)
    winners = F.broadcast(heavy_winners(rows, support))
    heavy = rows.join(winners, "digest")
    rest = rows.join(winners, "digest", "left_anti")
    # Counted in parts before the shuffle; rows then meet one row for each digest, under a key made anew, so Spark may split a large group.
    groups = rest.groupBy("digest").agg(F.max(F.struct("doc_id", "row_id")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    key = F.struct("digest").alias("__key")
    light = rest.select(key, *rows.columns).join(groups.select(key, "keep", "group_size"), "__key").select(*rows.columns, "keep", "group_size")
    return heavy.unionByName(light).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("keep.row_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "row_id",
        "raw_hash",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    return keep_rows(docs, exact_groups(docs, id_col, text_col, support).where(F.col("group_size") > 1), id_col, text_col)


def op10_exact_dedup(spark, sf_dir):
    return exact_groups(read(spark, sf_dir, "documents")).drop("row_id", "raw_hash")


SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""
