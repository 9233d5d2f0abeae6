"""Alignments as a stream: every micro-batch leaves partial tables, named by its number, which are merged when they are read.

A batch that runs again, because the query stopped in it, writes its own folder
over, so no read counts twice; sums over batches are what one batch of all
reads gives. What is held between batches is the source's position only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..engine import molecule_tags, raw_reads
from ..operators.thinning import CLASSES
from ..session import kept

#: More reads than a tag of one batch can have: the limit holds for the merged table.
ALL = (1 << 63) - 1


class Progress(StreamingQueryListener):
    """Counters of running queries: batches, rows, and rows a second of the last batch, by query id. Add it with spark.streams.addListener."""

    def __init__(self):
        self.counters: dict[str, dict] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self.counters.setdefault(str(event.id), {"batches": 0, "rows": 0, "rows_per_second": 0.0})

    def onQueryProgress(self, event) -> None:
        now = event.progress
        found = self.counters.setdefault(str(now.id), {"batches": 0, "rows": 0, "rows_per_second": 0.0})
        if now.numInputRows:
            found["batches"] += 1
            found["rows"] += now.numInputRows
            found["rows_per_second"] = now.processedRowsPerSecond

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.id))


def in_batches(stream: DataFrame, parts: dict[str, Callable[[DataFrame], DataFrame]], folder: str) -> StreamingQuery:
    """Starts a query that works through all the source has: of every batch, what each of `parts` makes of it goes to folder/name/batch=number."""

    def write(batch: DataFrame, number: int) -> None:
        rows = kept(batch)
        for name, make in parts.items():
            make(rows).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()


def merged(spark: SparkSession, folder: str, name: str, keys: list[str], sums: list[str]) -> DataFrame:
    """The sums of all batches so far."""
    return spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}").groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def stream_reads(reads: DataFrame, genes: DataFrame, library: tuple, folder: str, **options) -> StreamingQuery:
    """Starts counting a stream of alignments (stream_sam): molecule tags and read statuses of each batch go to the folder. Options as in raw_reads."""

    def judged(rows: DataFrame) -> DataFrame:
        return raw_reads(rows, genes, library, **options)

    parts = {
        "tags": lambda rows: molecule_tags(judged(rows), ALL),
        "status": lambda rows: judged(rows).groupBy("status", "random_hex").agg(F.count(F.lit(1)).alias("n")),
    }
    return in_batches(reads, parts, folder)


def streamed_tags(spark: SparkSession, folder: str, top: int = 65535) -> DataFrame:
    """The molecule table of all batches so far, as molecule_tags has it for all their reads."""
    found = merged(spark, folder, "tags", ["cb", "gene", "umi", "random_hex"], list(CLASSES))
    return found.withColumns({c: F.least(c, F.lit(top)) for c in CLASSES})


def streamed_status(spark: SparkSession, folder: str) -> DataFrame:
    return merged(spark, folder, "status", ["status", "random_hex"], ["n"])
