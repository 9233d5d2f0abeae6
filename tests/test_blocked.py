"""Blocked gzip in splits: every record once, wherever files are split."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from cambium.sources import binary, blocked, files

from test_files import alignments, as_bam, as_sam
from test_files import blocked as packed


@pytest.fixture
def splits_of(spark):
    """Sets the bytes of a split, and puts the setting back."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]

    def put(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], 0)

    yield put
    for name, value in zip(names, before, strict=True):
        spark.conf.set(name, value)


def many(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.randrange(4)
        chrom = rng.choice(["chr1", "chr2", None])
        rows.append((f"read{i}." + "x" * rng.randrange(60), 4 if chrom is None else rng.choice([0, 16]), chrom, -1 if chrom is None else rng.randrange(10**6), rng.randrange(256), "*" if kind == 0 else f"{rng.randrange(1, 90)}M{rng.randrange(1, 900)}N7M", None if kind == 1 else "ACGT-1", "ACGTACGTACGT"))
    return rows


@pytest.mark.parametrize("ranges", [1, 3, 17])
def test_splits_of_one_file(spark, tmp_path, splits_of, ranges):
    rows = many(1500)
    whole = packed(as_bam(rows), 700)
    (tmp_path / "a.bam").write_bytes(whole)
    (tmp_path / "a.sam").write_text(as_sam(rows))
    splits_of(len(whole) // ranges + 1)
    found = binary.read_bam(spark, str(tmp_path / "a.bam"))
    want = files.read_sam(spark, str(tmp_path / "a.sam"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, want.select(*found.columns).collect()), key=str)
    assert blocked.blocks(spark, str(tmp_path / "a.bam")).select("start").distinct().count() >= min(ranges, 50)


def test_long_records_and_several_files(spark, tmp_path, splits_of):
    """Records longer than a split, and blocks that end within a record's size."""
    rows = many(40, 2)
    rows += [(f"long{i}", 0, "chr1", i, 255, "1M2N" * 2000, "ACGT-1", "A" * 3000) for i in range(3)]
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.bam").write_bytes(packed(as_bam(rows[i::3]), 37 + i))
    splits_of(1200)
    found = binary.read_bam(spark, str(tmp_path / "in")).select("qname", "pos", "umi").collect()
    assert sorted(map(tuple, found)) == sorted((r[0], r[3], r[7]) for r in rows)


def test_wrong_guesses_are_corrected(spark, tmp_path, splits_of):
    class Wrong(binary.Alignments):
        def guess(self, data):
            return 5 if len(data) % 2 else None

    rows = many(200, 3)
    whole = packed(as_bam(rows), 700)
    (tmp_path / "a.bam").write_bytes(whole)
    splits_of(len(whole) // 6)
    found = blocked.Splits(spark, str(tmp_path / "a.bam"), Wrong())
    assert found.rounds >= 5

    def names(parts):
        import pyarrow as pa

        for _, data in parts:
            at, out = 0, []
            while at < len(data):
                out.append(data[at + 36 : at + 36 + data[at + 12] - 1].decode())
                at += 4 + struct.unpack_from("<i", data, at)[0]
            yield pa.RecordBatch.from_arrays([pa.array(out)], ["qname"])

    assert sorted(r[0] for r in found.records(names, "qname string").collect()) == sorted(r[0] for r in rows)


def test_broken_files(spark, tmp_path):
    whole = packed(as_bam(alignments()))
    for name, content, said in (("text", b"no blocks here", "isn't blocked gzip"), ("cut", whole[:-40], "ends too early|ends within a record"), ("bit", whole[:150] + bytes([whole[150] ^ 1]) + whole[151:], "checksum|invalid|ends too early|ncorrect"), ("other", packed(b"not a BAM"), "not a BAM file"), ("half", packed(as_bam(alignments())[:-3]), "ends within a record")):
        (tmp_path / f"{name}.bam").write_bytes(content)
        with pytest.raises(Exception, match=said):
            binary.read_bam(spark, str(tmp_path / f"{name}.bam")).count()


def test_written_files_come_back(spark, tmp_path, splits_of):
    rows = many(3000, 4)
    table = spark.createDataFrame([(*r[:6], r[6], r[7], None) for r in rows], "qname string, flag int, chrom string, pos long, mapq int, cigar string, cb string, umi string, gx string").repartition(3)
    binary.write_bam(table, str(tmp_path / "out"), [("chr1", 10**6), ("chr2", 10**6)], chunk=20_000)
    splits_of(9000)
    found = binary.read_bam(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, table.select(*found.columns).collect()), key=str)
    for part in (tmp_path / "out").glob("part-*"):
        raw, out = part.read_bytes(), b""
        assert raw.endswith(blocked.EMPTY)
        while raw:
            member = zlib.decompressobj(31)
            out += member.decompress(raw)
            raw = member.unused_data
        assert out[:4] == b"BAM\1"


def test_tag_files_in_splits(spark, tmp_path, splits_of):
    rng = random.Random(8)
    rows = [(b, g, rng.randrange(2**32), rng.randrange(2**16), 0, g % 3, 16 * (g % 2)) for b in range(60) for g in range(rng.randrange(1, 40))]
    tags = spark.createDataFrame(rows, "barcode long, gene long, umi long, spliced long, unspliced long, ambiguous long, flags int")
    binary.write_tag_file(tags, str(tmp_path / "t"), 2)
    for size in (10**6, 700):
        splits_of(size)
        found = binary.read_tag_file(spark, str(tmp_path / "t"))
        assert found.columns == tags.columns and sorted(map(tuple, found.collect())) == sorted(rows)
    assert found.groupBy("barcode").agg(F.count("*").alias("n")).count() == 60
