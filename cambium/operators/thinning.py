"""Binomial thinning of the reads behind each tag.

A read stays if the hash of (seed, tag, class, number) is below the fraction, so
a fraction's reads are among those of any larger one, and the result depends
neither on partitions nor on their order. The grid of fractions and seeds is
data: hashes are computed once a seed and compared with every fraction.
"""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = ("spliced", "unspliced", "ambiguous")


def read_hashes(name: str, exact: bool) -> str:
    """Hashes, below 2^32, of a class's reads; MD5 where other engines must agree, else xxhash64."""
    key = f"concat_ws('|', seed, barcode, gene, umi, '{name}', i)"
    hashed = f"cast(conv(substr(md5({key}), 1, 8), 16, 10) as long)" if exact else f"shiftrightunsigned(xxhash64(seed, barcode, gene, umi, '{name}', i), 32)"
    return f"CASE WHEN {name} > 0 THEN transform(sequence(1L, {name}), i -> {hashed}) ELSE cast(array() as array<bigint>) END"


def thin(tags: DataFrame, fracs: list[float], seeds: list[int] = (42,), exact: bool = True) -> DataFrame:
    """seed, frac_idx, frac and the tags with the reads that stay; tags without reads are dropped. A fraction of 1 keeps all."""
    spark = tags.sparkSession
    grid = spark.createDataFrame([(i, float(f)) for i, f in enumerate(fracs)], "frac_idx int, frac double")
    hashed = tags.withColumn("seed", F.explode(F.array(*[F.lit(int(s)).cast("long") for s in seeds]))).withColumns({f"h_{c}": F.expr(read_hashes(c, exact)) for c in CLASSES})
    kept = {c: F.expr(f"CASE WHEN frac = 1 THEN {c} ELSE size(filter(h_{c}, h -> h < frac * 4294967296)) END").cast("long") for c in CLASSES}
    return hashed.crossJoin(F.broadcast(grid)).withColumns(kept).drop(*[f"h_{c}" for c in CLASSES]).where("spliced + unspliced + ambiguous > 0")


#: Reads drawn at once.
READS = 1 << 16
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def tag_hash(seed: int, name: str) -> Column:
    """What the hashes of a class's reads begin with; `drawn` adds their numbers."""
    return F.xxhash64(F.lit(seed).cast("long"), "barcode", "gene", "umi", F.lit(name))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _with_number(start: np.ndarray, i: np.ndarray) -> np.ndarray:
    """XXH64 of each number (8 bytes) with `start` as its seed: what xxhash64 makes of one more column."""
    h = start + (_P5 + np.uint64(8))
    h ^= _turned(i * _P2, 31) * _P1
    h = _turned(h, 27) * _P1 + _P4
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    return h ^ (h >> np.uint64(32))


def drawn(start: np.ndarray, reads: np.ndarray, fracs: np.ndarray) -> np.ndarray:
    """(tags, fractions): how many of each tag's reads stay, those that `thin` keeps without `exact`. Each read is hashed once, READS at a time."""
    order = np.argsort(fracs, kind="stable")
    limits = fracs[order] * 4294967296.0
    below = np.zeros((len(reads), len(fracs) + 1), np.int64)
    ends = np.cumsum(reads)
    total = int(ends[-1]) if len(ends) else 0
    start = start.view(np.uint64)
    for first in range(0, total, READS) if fracs.min() < 1 else ():
        last = min(total, first + READS)
        low, high = np.searchsorted(ends, [first, last - 1], "right")
        cuts = np.clip(ends[low : high + 1], first, last)
        tag = np.repeat(np.arange(low, high + 1), np.diff(cuts, prepend=first))
        number = (np.arange(first + 1, last + 1) - (ends - reads)[tag]).astype(np.uint64)
        hashed = (_with_number(start[tag], number) >> np.uint64(32)).astype(np.float64)
        small = hashed < limits[-1]
        place = np.searchsorted(limits, hashed[small], "right")
        width = len(fracs) + 1
        below[low : high + 1] += np.bincount((tag[small] - low) * width + place, minlength=(high + 1 - low) * width).reshape(-1, width)
    out = np.empty((len(reads), len(fracs)), np.int64)
    out[:, order] = np.cumsum(below[:, :-1], axis=1)
    out[:, fracs == 1] = reads[:, None]
    return out
