"""Sequences of A, C, G, T as numbers of two bits a base; the first base is the most significant."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(seq: Column) -> Column:
    """The number of a sequence, in either case; null for any other letter."""
    return F.when(seq.rlike("^[ACGTacgt]{1,16}$"), F.conv(F.translate(F.upper(seq), "ACGT", "0123"), 4, 10).cast("long"))


def decode(value: Column, length: int) -> Column:
    bases = [F.substring(F.lit("ACGT"), (F.shiftright(value, 2 * i).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1)) for i in reversed(range(length))]
    return F.concat(*bases)


def hamming(x: Column, y: Column) -> Column:
    """Bases that differ."""
    d = x.bitwiseXOR(y)
    return F.bit_count(d.bitwiseOR(F.shiftright(d, 1)).bitwiseAND(F.lit(0x55555555)))


def neighbours(x: Column, length: int) -> Column:
    """All sequences that differ in one base."""
    return F.array(*[x.bitwiseXOR(F.lit(k << 2 * i).cast("long")) for i in range(length) for k in (1, 2, 3)])


def grid_place(barcode: Column) -> Column:
    """array_row and array_col of barcodes that carry them, like s_002um_00320_02575-1; null for others."""
    part = lambda i: F.nullif(F.regexp_extract(barcode, "um_([0-9]+)_([0-9]+)-", i), F.lit("")).cast("long")
    return F.struct(part(1).alias("array_row"), part(2).alias("array_col"))
