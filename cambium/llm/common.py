"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Bytes above 0x7F stay: they belong to letters outside ASCII.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_az(column):
    """Lower-case A-Z only; letters outside ASCII keep their case."""
    return F.translate(column, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a temporary one in local mode (tests) and an error on a cluster."""
    set_already = spark.sparkContext.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or set_already
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="cambium-")
    if set_already is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed when the application ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Compute df once, into the shared checkpoint folder; what reads it later survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a few longs that make a partition worth a task.
PART_ROWS = 100_000


def narrow(df: DataFrame, rows: int) -> DataFrame:
    """df, of at most about `rows` rows of a few longs, in as many partitions as those need, without a shuffle: each partition more costs a file of every later shuffle."""
    return df.coalesce(max(1, -(-rows // PART_ROWS)))


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def sliced(batches: Iterator[pa.RecordBatch], text: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose texts take at most about `limit` bytes. After the last, what Arrow keeps for later is given back: the worker goes on to other tasks."""
    for batch in batches:
        column = batch.column(text)
        if batch.num_rows < 2 or column.nbytes <= limit:
            yield batch
            continue
        rows = max(1, int(batch.num_rows * limit / column.nbytes))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()


#: Bytes of a batch of rows on its way to Python, at most about; Spark's own limit is 10,000 rows of any length. Both the JVM and the worker hold them.
BATCH_BYTES = 2 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python in batches of BATCH_BYTES, if the session has no limit of its own."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


#: Longs of a filter of keys: at most so many rows are broadcast, however many keys there are.
FILTER_LONGS = 1 << 19
#: Tables of at most so many rows are broadcast whole.
SMALL_ROWS = 100_000


def maybe_in(docs: DataFrame, key, keys: DataFrame, key_col: str, longs: int = FILTER_LONGS) -> DataFrame:
    """`docs` with __maybe: false only where the long `key` is surely not among `keys`.

    The keys become bits of a table of bounded size, which is broadcast; the
    more keys there are, the more rows are marked without need.
    """
    slots = keys.select(F.pmod(key_col, F.lit(longs)).alias("__slot"), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(key_col, 58).cast("int")).alias("__bit"))
    # At most `longs` rows, by the modulus.
    bits = F.broadcast(slots.groupBy("__slot").agg(F.bit_or("__bit").alias("__bits")))
    marked = docs.withColumn("__key", key).join(bits, F.pmod("__key", F.lit(longs)) == F.col("__slot"), "left")
    hit = F.call_function("shiftright", F.col("__bits"), F.shiftrightunsigned("__key", 58).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    return marked.withColumn("__maybe", F.coalesce(hit, F.lit(False))).drop("__key", "__slot", "__bits")


def keep_rows(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text", small_rows: int = SMALL_ROWS) -> DataFrame:
    """`docs` without the rows that `decided` (doc_id, raw_hash, kept) drops; rows it doesn't name stay.

    Rows are told apart by id and a hash of the raw text. Of rows that are the
    same in both, one stays if any of them is kept; only those are aggregated.
    Texts are shuffled only if there are many decisions, and then only texts
    that a filter of bounded size can't tell from decided ones.
    """
    found = cut(
        decided.groupBy("doc_id", "raw_hash")
        .agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("same"))
        .where(~F.col("stays") | (F.col("same") > 1))
        .select(F.col("doc_id").alias("__found_id"), F.col("raw_hash").alias("__found_hash"), F.col("stays").alias("__stays"))
    )
    same = F.col("__id").eqNullSafe(F.col("__found_id")) & (F.col("__hash") == F.col("__found_hash"))
    # Rows travel as one column, so no column's name can clash.
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__hash"))
    if found.limit(small_rows + 1).count() <= small_rows:
        marked = named.join(F.broadcast(found), same, "left")
        alone = marked.where(F.col("__stays").isNull()).select("__row")
    else:
        key = F.xxhash64("__id", "__hash")
        asked = maybe_in(named, key, found.select(F.xxhash64("__found_id", "__found_hash").alias("__found_key")), "__found_key")
        marked = asked.where("__maybe").join(found, same, "left")
        alone = asked.where("NOT __maybe").select("__row").unionByName(marked.where(F.col("__stays").isNull()).select("__row"))
    if not found.where("__stays").isEmpty():
        alone = alone.unionByName(marked.where("__stays").dropDuplicates(["__id", "__hash"]).select("__row"))
    return alone.select("__row.*")


def fresh(columns: list[str], name: str) -> str:
    """A name that no column has."""
    while name.lower() in map(str.lower, columns):
        name = f"_{name}"
    return name


def running(df: DataFrame, order: list, amount: str, into: str) -> DataFrame:
    """df over all partitions in `order`, with the long `into`: the sum of the long `amount` over all rows before.

    One range shuffle; sums inside partitions, then offsets from one sum a
    partition, so no task sees all rows. Equal keys share a partition. The
    result is cut, for the offsets have to fit the very partitions they come from.
    """
    kind = df.schema

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = batch.column(batch.schema.get_field_index(amount)).to_numpy(zero_copy_only=False)
            sums = before + np.cumsum(own)
            if len(own):
                before = int(sums[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums - own, pa.int64()), pa.array(np.full(len(own), part), pa.int64())], [*batch.schema.names, into, "__part"])

    fields = T.StructType([*kind.fields, T.StructField(into, T.LongType()), T.StructField("__part", T.LongType())])
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(summed, fields))
    parts = placed.groupBy("__part").agg(F.sum(amount).alias("__sum"))  # one row a partition
    offsets = parts.select("__part", (F.sum("__sum").over(Window.orderBy("__part")) - F.col("__sum")).alias("__before"))
    return placed.join(F.broadcast(offsets), "__part").withColumn(into, F.col(into) + F.col("__before")).drop("__part", "__before")
