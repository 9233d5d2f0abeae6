"""Binary sources in blocked gzip: alignments (BAM) and molecule tags. Files of any size are read in splits; see `blocked`."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocked import Framing, Splits, write_blocks

BATCH = 20_000
TAG = np.dtype([("gene", "<u4"), ("umi", "<u4"), ("spliced", "<u2"), ("unspliced", "<u2"), ("ambiguous", "<u2"), ("flags", "<u2")])
TAGS = "barcode long, gene long, umi long, spliced long, unspliced long, ambiguous long, flags int"
#: The operations of a CIGAR string, and the sizes of a tag's values, in the format's order.
OPERATIONS = "MIDNSHP=X"
SIZES = {b"A": 1, b"c": 1, b"C": 1, b"s": 2, b"S": 2, b"i": 4, b"I": 4, b"f": 4}


class Alignments(Framing):
    """A header with text and references, then records that begin with their size."""

    head, seen = 4, 36

    def preamble(self, data: bytes) -> tuple[int, list[str]] | None:
        if data[:4] != b"BAM\1"[: len(data)]:
            raise ValueError("not a BAM file")
        if len(data) < 12 or len(data) < (at := 8 + struct.unpack_from("<i", data, 4)[0]) + 4:
            return None
        names, left = [], struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(left):
            if len(data) < at + 4 or len(data) < (end := at + 8 + struct.unpack_from("<i", data, at)[0]):
                return None
            names.append(data[at + 4 : end - 5].decode())
            at = end
        return at, names

    def size(self, data, at: int) -> int:
        size = struct.unpack_from("<i", data, at)[0]
        if size < 32:
            raise ValueError("a record of less than 32 bytes")
        return 4 + size

    def plausible(self, data, at: int) -> bool:
        size, ref, pos, name, _, _, ops, _, bases, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
        if min(ref, pos, mate, mate_pos) < -1 or name < 1 or bases < 0 or 32 + name + 4 * ops + (bases + 1) // 2 + bases > size:
            return False
        end = at + 36 + name - 1
        return end >= len(data) or (data[end] == 0 and all(33 <= c <= 126 for c in data[at + 36 : end]))


class Molecules(Framing):
    """For each barcode its number, count and size (12 bytes), then 16 bytes a tag."""

    head, seen = 12, 12

    def size(self, data, at: int) -> int:
        barcode, n, size = struct.unpack_from("<III", data, at)
        if size != n * TAG.itemsize:
            raise ValueError(f"barcode {barcode}: {n} tags in {size} bytes")
        return 12 + size

    def plausible(self, data, at: int) -> bool:
        _, n, size = struct.unpack_from("<III", data, at)
        return 0 < n == size / TAG.itemsize


def bam_tags(raw: bytes, wanted: dict[bytes, int]) -> list[str | None]:
    """Text of the wanted tags of a record's tag section."""
    found: list[str | None] = [None] * len(wanted)
    at = 0
    while at + 3 <= len(raw):
        name, kind = raw[at : at + 2], raw[at + 2 : at + 3]
        at += 3
        if kind in (b"Z", b"H"):
            end = raw.index(b"\0", at)
            if name in wanted:
                found[wanted[name]] = raw[at:end].decode()
            at = end + 1
        elif kind == b"B":
            at += 5 + SIZES[raw[at : at + 1]] * struct.unpack_from("<i", raw, at + 1)[0]
        else:
            at += SIZES[kind]
    return found


def alignment(record: bytes, chroms: list[str], wanted: dict[bytes, int]) -> tuple:
    """A row of read_bam, of a record after its size."""
    ref, pos, name_size, mapq, _, n_ops, flag, bases = struct.unpack_from("<iiBBHHHi", record)
    at = 32 + name_size
    ops = struct.unpack_from(f"<{n_ops}I", record, at)
    cigar = "".join(f"{op >> 4}{OPERATIONS[op & 15]}" for op in ops) or "*"
    tags = bam_tags(record[at + 4 * n_ops + (bases + 1) // 2 + bases :], wanted)
    return record[32 : at - 1].decode(), flag, chroms[ref] if ref >= 0 else None, pos, mapq, cigar, *tags


def read_bam(spark: SparkSession, path: str, tags: dict[str, str] | None = None) -> DataFrame:
    """The columns of read_sam: qname, flag, chrom (null if unmapped), pos (from 0), mapq, cigar and the wanted text tags. A file is dealt to tasks in splits."""
    tags = tags or {"cb": "CB", "umi": "UR", "gx": "GX"}
    wanted = {tag.encode(): i for i, tag in enumerate(tags.values())}
    names = ["qname", "flag", "chrom", "pos", "mapq", "cigar", *tags]
    text = pa.string()
    kinds = [text, pa.int32(), text, pa.int64(), pa.int32(), text, *[text] * len(tags)]

    def parse(parts: Iterator[tuple[list[str], bytes]]) -> Iterator[pa.RecordBatch]:
        packed = lambda held: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
        held = []
        for chroms, data in parts:
            at = 0
            while at < len(data):
                end = at + 4 + struct.unpack_from("<i", data, at)[0]
                held.append(alignment(data[at + 4 : end], chroms, wanted))
                at = end
            if len(held) >= BATCH:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    schema = "qname string, flag int, chrom string, pos long, mapq int, cigar string" + "".join(f", {n} string" for n in tags)
    return Splits(spark, path, Alignments()).records(parse, schema)


def packed_tag(tag: str, value: str | None) -> bytes:
    return b"" if value is None else tag.encode() + b"Z" + value.encode() + b"\0"


def write_bam(reads: DataFrame, path: str, chroms: list[tuple[str, int]], tags: dict[str, str] | None = None, chunk: int = 1 << 20) -> None:
    """Rows of read_bam as one BAM file for each partition, without bases. `chroms` are names and lengths."""
    tags = tags or {"cb": "CB", "umi": "UR", "gx": "GX"}
    number = {name: i for i, (name, _) in enumerate(chroms)}
    opening = b"BAM\1" + struct.pack("<ii", 0, len(chroms)) + b"".join(struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size) for name, size in chroms)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [opening], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["chunk"])
        for batch in batches:
            for qname, flag, chrom, pos, mapq, cigar, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ops, n = [], 0
                for c in cigar.encode() if cigar and cigar != "*" else b"":
                    if 48 <= c <= 57:
                        n = 10 * n + c - 48
                    else:
                        ops.append(n << 4 | OPERATIONS.index(chr(c)))
                        n = 0
                name = qname.encode() + b"\0"
                body = struct.pack("<iiBBHHHiiii", number[chrom] if chrom else -1, pos, len(name), mapq, 0, len(ops), flag, 0, -1, -1, 0) + name + struct.pack(f"<{len(ops)}I", *ops)
                body += b"".join(map(packed_tag, tags.values(), values))
                held.append(struct.pack("<i", len(body)) + body)
                size += len(held[-1])
                if size > chunk:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    write_blocks(reads.select("qname", "flag", "chrom", "pos", "mapq", "cigar", *tags).mapInArrow(packed, "chunk binary"), path)


def read_tag_file(spark: SparkSession, path: str) -> DataFrame:
    """TAGS of a binary molecule file. A file is dealt to tasks in splits."""

    def parse(parts: Iterator[tuple[list[str], bytes]]) -> Iterator[pa.RecordBatch]:
        for _, data in parts:
            at = 0
            while at < len(data):
                barcode, n, size = struct.unpack_from("<III", data, at)
                tags = np.frombuffer(data, TAG, n, at + 12) if n else np.empty(0, TAG)
                at += 12 + size
                for start in range(0, n, BATCH):
                    part = tags[start : start + BATCH]
                    columns = [np.full(len(part), barcode, np.int64), *[part[c].astype(np.int64) for c in TAG.names[:-1]], part["flags"].astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["barcode", *TAG.names])

    return Splits(spark, path, Molecules()).records(parse, TAGS)


def write_tag_file(tags: DataFrame, path: str, partitions: int | None = None) -> None:
    """TAGS as binary molecule files, one for each partition: whole barcodes, in the order of barcode, gene and tag."""
    names = ["barcode", *TAG.names]
    dealt = tags.repartition(partitions, "barcode") if partitions else tags.repartition("barcode")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def out() -> pa.RecordBatch:
            rows = np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array([struct.pack("<III", at, len(rows), rows.nbytes) + rows.tobytes()], pa.binary())], ["chunk"])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rows = np.empty(batch.num_rows, TAG)
            for name, column in zip(TAG.names, columns[1:], strict=True):
                rows[name] = column
            turns = np.flatnonzero(np.diff(columns[0])) + 1
            for start, end in zip([0, *turns], [*turns, len(rows)], strict=True):
                if start == end:
                    continue
                if columns[0][start] != at and held:
                    yield out()
                    held = []
                at = int(columns[0][start])
                held.append(rows[start:end])
        if held:
            yield out()

    chunks = dealt.select(*[F.col(n).cast("long") for n in names]).sortWithinPartitions("barcode", "gene", "umi")
    write_blocks(chunks.mapInArrow(packed, "chunk binary"), path)
