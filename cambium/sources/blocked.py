"""Records in blocked gzip files of any size, read in splits.

Every block starts with the same 16 bytes, so Spark's text source can split a
file at them like lines, and a task sees whole blocks of 64 KB at most. What a
split doesn't know is where its first record starts. It guesses: the first
place from which a chain of plausible records leads on. `Splits` then follows
each file from split to split and compares: a record that begins in one split
says where the next begins. Splits that guessed wrongly are read again from the
right place, until all agree, so that every record is read once and no guess
decides. Records over the edge of splits are put together from what either side
has of them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import kept

#: What all blocks start with (gzip with an extra field BC of two bytes), and an empty block, which ends a file.
START = bytes.fromhex("1f8b08040000000000ff0600424302 00".replace(" ", ""))
EMPTY = START + bytes.fromhex("1b0003000000000000000000")
#: Bytes of a split that a guess looks at, at least; plausible records in a row that it needs.
LOOK, CHAIN = 1 << 20, 8
#: Uncompressed bytes of a block, at most.
BLOCK = 0xFF00


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """path, start (of the split) and block (what follows START) of all blocks, in order within a split."""
    lines = spark.read.option("encoding", "ISO-8859-1").option("lineSep", START.decode("latin-1")).text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("block"))


def inflate(block: bytes) -> bytes:
    if len(block) < 12 or struct.unpack_from("<H", block)[0] + 1 != len(block) + len(START):
        raise ValueError("a compressed block ends too early")
    data = zlib.decompress(block[2:-8], -15)
    if struct.unpack_from("<II", block, len(block) - 8) != (zlib.crc32(data), len(data)):
        raise ValueError("a block's checksum or length doesn't agree with its data")
    return data


def squeezed(raw: bytes, size: int = BLOCK) -> bytes:
    """Whole blocks of these bytes."""
    out = []
    for at in range(0, len(raw), size):
        part = raw[at : at + size]
        squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = squeeze.compress(part) + squeeze.flush()
        out.append(START + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def write_blocks(chunks: DataFrame, path: str) -> None:
    """A file for each partition, of the bytes in the column `chunk` in order; every chunk starts a block, and an empty block follows it."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([squeezed(c) for c in batch.column(0).to_pylist()], pa.binary())], ["chunk"])

    text = chunks.select("chunk").mapInArrow(packed, "chunk binary").select(F.col("chunk").cast("string").alias("value"))
    text.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).text(path)


class Framing:
    """How a format's records follow each other."""

    #: Bytes that tell a record's size, and those that a guess needs.
    head, seen = 4, 4

    def preamble(self, data: bytes) -> tuple[int, list[str]] | None:
        """Bytes before a file's first record, and names that its records refer to; None if more data are needed."""
        return 0, []

    def size(self, data, at: int) -> int:
        """Of the whole record at this place, of which `head` bytes are there."""
        raise NotImplementedError

    def plausible(self, data, at: int) -> bool:
        """Whether a record may begin at this place, `seen` bytes of which are there."""
        raise NotImplementedError

    def guess(self, data: bytes) -> int | None:
        """The first place from which plausible records follow each other, up to CHAIN or the end; None if there is none."""
        for at in range(len(data) - self.seen + 1):
            to = at
            for _ in range(CHAIN):
                if to + self.seen > len(data):
                    break
                if not self.plausible(data, to):
                    to = None
                    break
                to += self.size(data, to)
            if to is not None:
                return at
        return None


def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, list[bytes]]]:
    """The consecutive blocks of a split: (path, start and further columns), blocks. An empty first block is what precedes a file's START."""
    keys = list(zip(*(c.to_pylist() for c in [*batch.columns[:2], *batch.columns[3:]]), strict=True))
    found = batch.column(2).to_pylist()
    at = 0
    while at < len(keys):
        to = at
        while to < len(keys) and keys[to][:2] == keys[at][:2]:
            to += 1
        yield keys[at], found[at:to]
        at = to


def split_data(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """Each split of a task and its inflated blocks, which are to be read before the next split is asked for."""
    pending: list = []

    def parts() -> Iterator[tuple[tuple, list[bytes]]]:
        for batch in batches:
            yield from runs(batch)

    source = parts()

    def inflated(key: tuple, found: list[bytes]) -> Iterator[bytes]:
        first = key[1] == 0
        while True:
            for block in found:
                if first:
                    first = False
                    if block:
                        raise ValueError(f"{key[0]} isn't blocked gzip")
                    continue
                yield inflate(block)
            after = next(source, None)
            if after is None:
                return
            if after[0][:2] != key[:2]:
                pending.append(after)
                return
            found = after[1]

    while (entry := pending.pop() if pending else next(source, None)) is not None:
        data = inflated(*entry)
        yield entry[0], data
        for _ in data:  # what wasn't read
            pass


SURVEY = "path string, start long, size long, at long, first binary, head binary, tail binary, names array<string>"


def survey(framing: Framing, found: DataFrame) -> DataFrame:
    """SURVEY of each split of blocks (path, start, block, given): its inflated size, where its first record is guessed or given to start (None: no guess), its first bytes, what precedes that record and what the last record has of it."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, start, given), data in split_data(batches):
            held, names, at = b"", None, given
            if start == 0:
                while (opening := framing.preamble(held)) is None:
                    more = next(data, None)
                    if more is None:
                        raise ValueError(f"the header of {path} doesn't end in its first split")
                    held += more
                at, names = opening
            enough = LOOK if at is None else framing.seen
            while len(held) < enough and (more := next(data, None)) is not None:
                held += more
            if at is None:
                at = framing.guess(held)
            first = held[: framing.seen]
            if at is None:
                size = len(held) + sum(map(len, data))
                # A split inside one long record is all of it needed for that record.
                row = (path, start, size, None, first, held if size == len(held) else b"", b"", names)
            else:
                size = len(held)
                while size <= at and (more := next(data, None)) is not None:
                    held += more
                    size += len(more)
                head, rest = held[:at], held[at:]
                while True:
                    to = 0
                    try:
                        while to + framing.head <= len(rest) and to + (n := framing.size(rest, to)) <= len(rest):
                            to += n
                    except ValueError:
                        if given is not None or start == 0:
                            raise
                        at, to = None, len(rest)  # it was guessed wrongly
                    rest = rest[to:]
                    more = next(data, None)
                    if more is None:
                        break
                    size += len(more)
                    if at is not None:
                        rest += more
                row = (path, start, size, None, first, b"", b"", names) if at is None else (path, start, size, min(at, size), first, head, rest, names)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in SURVEY.split(", ")])

    return found.select("path", "start", "block", "given").mapInArrow(look, SURVEY)


def followed(framing: Framing, splits: list[dict]) -> Iterator[tuple[int, int, bool, bytes | None]]:
    """Of a file's splits in order: start, where the first record starts, whether the split has it so, and the record that ends in the split and begins before it. Nothing after the first that hasn't."""
    carry, ended = b"", True
    for n, split in enumerate(splits):
        size, begun = split["size"], carry + split["first"]
        if n == 0:
            right = min(split["at"], size)
        elif not carry:
            right = 0
        elif len(begun) < framing.head:
            right = size
        else:
            right = min(framing.size(begun, 0) - len(carry), size)
        inside = split["at"] is None and right == size == len(split["head"])
        if not inside and split["at"] != right:
            yield split["start"], right, False, None
            return
        record = None
        if n and carry:
            carry += split["head"]
            if len(carry) >= framing.head and framing.size(carry, 0) == len(carry):
                record, carry = carry, b""
        if right < size:
            carry = split["tail"]
        ended = not carry
        yield split["start"], right, True, record
    if not ended:
        raise ValueError("the file ends within a record")


class Splits:
    """Where each split's first record starts, and the records over the edges.

    `table` has a row for each split (path, start, at, ok, record); `names` what
    each file's records refer to. The parts of records that a file's splits
    begin and end with, less than a record each, meet in one task.
    """

    def __init__(self, spark: SparkSession, path: str, framing: Framing):
        self.blocks, self.framing = blocks(spark, path), framing
        surveyed = kept(survey(framing, self.blocks.withColumn("given", F.lit(None).cast("long"))))

        def follow(table: pa.Table) -> pa.Table:
            rows = sorted(table.to_pylist(), key=lambda r: r["start"])
            found = list(followed(framing, rows))
            columns = list(zip(*[(rows[0]["path"], *f) for f in found], strict=True))
            return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()], strict=True)], ["path", "start", "at", "ok", "record"])

        self.rounds = 0
        while True:
            self.table = kept(surveyed.groupBy("path").applyInArrow(follow, "path string, start long, at long, ok boolean, record binary"))
            wrong = self.table.where("NOT ok").select("path", "start", F.col("at").alias("given"))
            if wrong.isEmpty():
                break
            # One row for each file at most.
            again = survey(framing, self.blocks.join(F.broadcast(wrong), ["path", "start"]))
            surveyed = kept(surveyed.join(F.broadcast(wrong), ["path", "start"], "left_anti").unionByName(again))
            self.rounds += 1
        self.names = {r["path"]: r["names"] for r in surveyed.where("names IS NOT NULL").select("path", "names").collect()}  # one row a file

    def records(self, parse, schema: str) -> DataFrame:
        """What `parse` makes of the records: it takes an iterator of (names, whole records' bytes one after another) and yields record batches."""
        sent = self.blocks.sparkSession.sparkContext.broadcast(self.names)
        framing = self.framing

        def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def whole() -> Iterator[tuple[list[str], bytes]]:
                for (path, start, at), data in split_data(batches):
                    if at is None:
                        raise ValueError(f"{path} was split otherwise when it was surveyed (at {start})")
                    skip, rest = at, b""
                    for part in data:
                        if skip >= len(part):
                            skip -= len(part)
                            continue
                        rest, skip = rest + part[skip:], 0
                        to = 0
                        while to + framing.head <= len(rest) and to + (n := framing.size(rest, to)) <= len(rest):
                            to += n
                        if to:
                            yield sent.value[path], rest[:to]
                            rest = rest[to:]

            yield from parse(whole())

        def over_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from parse((sent.value[path], record) for batch in batches for path, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))

        # One row a split: the input's size by spark.sql.files.maxPartitionBytes.
        placed = self.blocks.join(F.broadcast(self.table.select("path", "start", "at")), ["path", "start"], "left").select("path", "start", "block", "at")
        edges = self.table.where("record IS NOT NULL").select("path", "record")
        return placed.mapInArrow(inside, schema).unionByName(edges.mapInArrow(over_edges, schema))
