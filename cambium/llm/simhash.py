"""SimHash near-duplicates: candidates by bands of bits, discarded by pivot distance tables, then verified and connected.

Distances to reference fingerprints alone can't bring near fingerprints
together without comparing all pairs: over 64 random bits they lie too close to
each other. So pairs meet in bands of bits, of which two fingerprints that
differ in at most three bits share at least one, and the pivot table discards
pairs there: sorted by the distance to the first reference, a fingerprint meets
only those at most three further on, and of these only pairs whose distances to
every other reference differ by at most three have their bits compared.

Groups of a band that are too large to be compared by one task are linked by
shared neighbours instead: two fingerprints differ in at most three bits if and
only if one that differs from the first in at most one bit differs from the
second in at most two. These neighbours are dealt over all tasks, and as many
as 2,081 fingerprints at most share one, no group grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, cut, keep_rows, maybe_in, narrow, read, sliced, utf8

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Reference fingerprints of the pivot table.
PIVOTS = 16
#: Larger groups of a band are linked by shared neighbours, over all tasks.
LARGE_GROUP = 8192
#: Pairs found before they are reduced to a forest.
PAIRS = 200_000


def pivots(count: int = PIVOTS) -> np.ndarray:
    return np.asarray([xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(count)], np.uint64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.translate(ASCII_LOWER).split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """row_id, doc_id, raw_hash (of the text) and fp (the fingerprint's bits as a long) of each row."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("raw_hash"), F.col(text_col).alias("text"))

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 3):
            found = pa.array([fingerprint(t, shingle, seed) for t in utf8(batch.column(3))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], found], ["row_id", "doc_id", "raw_hash", "fp"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(printed, f"row_id long, doc_id {kind}, raw_hash long, fp long")


def band_masks(blocks: int, bits: int = MAX_BITS) -> list[int]:
    """Masks of 64 bits such that two fingerprints that differ in at most `bits` bits agree under at least one: all but `bits` of `blocks` blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(chosen) for chosen in combinations(block, blocks - bits)]


def blocks_for(count: int, bits: int = MAX_BITS) -> int:
    """Blocks that keep the expected group of a band below about 32, up to 32 bits in a band."""
    blocks = bits + 1
    while blocks < 2 * bits and count > 32 << (64 * (blocks - bits) // blocks):
        blocks += 1
    return blocks


def reduced(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels, with those that pairs (a, b) connect brought to the smallest of their component."""
    while True:
        la, lb = labels[a], labels[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        if not (differ := low != high).any():
            return labels
        labels = labels.copy()
        np.minimum.at(labels, high[differ], low[differ])
        while not np.array_equal(labels, above := labels[labels]):
            labels = above


def link_groups(group: np.ndarray, prints: np.ndarray, tables: np.ndarray, bits: int, labels: np.ndarray) -> np.ndarray:
    """labels, connected by the pairs of the same group within `bits` bits. Rows are in the order of the group and then of tables[:, 0]."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at, step, size = np.arange(len(group)), 1, 0
    while True:
        at = at[at + step < len(group)]
        at = at[(group[at] == group[at + step]) & (tables[at + step, 0] - tables[at, 0] <= bits)]
        if not len(at):
            break
        near = at[np.abs(tables[at, 1:] - tables[at + step, 1:]).max(1, initial=0) <= bits]
        near = near[np.bitwise_count(prints[near] ^ prints[near + step]) <= bits]
        if len(near):
            found.append((near, near + step))
            size += len(near)
        if size > PAIRS:
            labels, found, size = reduced(labels, *map(np.concatenate, zip(*found, strict=True))), [], 0
        step += 1
    return reduced(labels, *map(np.concatenate, zip(*found, strict=True))) if found else labels


def linked(band: np.ndarray, prints: np.ndarray, bits: int, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For whole groups of equal `band`: the fingerprints that have a smaller place in their component, and those at that place."""
    tables = np.bitwise_count(prints[:, None] ^ references[None, :]).astype(np.int16)
    labels = np.arange(len(prints))
    order = np.lexsort((tables[:, 0], band))
    band, prints, tables = band[order], prints[order], tables[order]
    labels = link_groups(band, prints, tables, bits, labels)
    other = np.flatnonzero(labels != np.arange(len(labels)))
    return prints[other], prints[labels[other]]


LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def link_batch(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))], schema=LINK)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, most: int | None = None) -> Iterator[tuple[np.ndarray, bool]]:
    """The columns of sorted rows as longs, in pieces of whole groups of equal first `keys` columns; with `most`, larger groups come in parts and marked True."""
    rest, parted = None, None
    for batch in _and_end(batches):
        if batch is not None:
            now = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            rest = now if rest is None else np.concatenate([rest, now], 1)
        if rest is None or not rest.shape[1]:
            continue
        if parted is not None:
            same = (rest[:keys] == parted).all(0)
            if same.any():
                yield rest[:, same], True
                rest = rest[:, ~same]
            if not rest.shape[1]:
                continue
            parted = None
        same = (rest[:keys] == rest[:keys, -1:]).all(0)
        end = rest.shape[1] if batch is None else int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        now, rest = rest[:, :end], rest[:, end:]
        if end:
            fresh = np.concatenate([[True], (now[:keys, 1:] != now[:keys, :-1]).any(0)])
            sizes = np.diff(np.append(np.flatnonzero(fresh), end))
            large = np.repeat(sizes > most, sizes) if most else np.zeros(end, bool)
            if large.any():
                yield now[:, large], True
            if not large.all():
                yield now[:, ~large], False
        if most and rest.shape[1] > most:
            parted = rest[:keys, -1:]
            yield rest, True
            rest = rest[:, :0]


def numbered(now: np.ndarray, keys: int) -> np.ndarray:
    """The number of each row's group."""
    return np.concatenate([[0], np.cumsum((now[:keys, 1:] != now[:keys, :-1]).any(0))])


def links(prints: DataFrame, bits: int = MAX_BITS, blocks: int | None = None, large_group: int = LARGE_GROUP) -> DataFrame:
    """a, b: pairs within `bits` bits that connect all different fingerprints `fp` that such pairs connect."""
    blocks = blocks or blocks_for(prints.count(), bits)
    masks = [m - (1 << 64) if m >> 63 else m for m in band_masks(blocks, bits)]
    banded = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("band")) for i, m in enumerate(masks)])).alias("b"))
    dealt = banded.select("b.table", "b.band", "fp").repartition("table", "band").sortWithinPartitions("table", "band")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = pivots()
        for now, large in whole_groups(batches, 2, large_group):
            fps = np.ascontiguousarray(now[2]).view(np.uint64)
            yield link_batch(fps, None) if large else link_batch(*linked(numbered(now, 2), fps, bits, references))

    found = cut(dealt.mapInArrow(link, "a long, b long"))
    near, dense = found.where("b IS NOT NULL"), found.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    return near if dense.isEmpty() else near.unionByName(neighbour_links(cut(dense), bits))


def flips(bits: int) -> np.ndarray:
    """All masks of at most `bits` bits."""
    return np.asarray([sum(1 << i for i in c) for k in range(bits + 1) for c in combinations(range(64), k)], np.uint64)


def neighbour_links(prints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """As links(), for fingerprints of which very many are close: by the neighbours that they share."""

    def neighbours(most: int, outer: bool):
        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            masks = flips(most)
            step = max(1, (1 << 18) // len(masks))
            for batch in batches:
                fps = batch.column(0).to_numpy().view(np.uint64)
                for at in range(0, len(fps), step):
                    some = fps[at : at + step]
                    keys = (some[:, None] ^ masks[None, :]).ravel().view(np.int64)
                    rows = [pa.array(keys), pa.array(np.full(len(keys), int(outer), np.int64)), pa.array(np.repeat(some, len(masks)).view(np.int64))]
                    yield pa.RecordBatch.from_arrays(rows, ["key", "outer", "fp"])

        return prints.select("fp").mapInArrow(made, "key long, outer long, fp long")

    inner = neighbours(bits // 2, False)
    outer = maybe_in(neighbours(bits - bits // 2, True), F.col("key"), inner, "key").where("__maybe").drop("__maybe")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, _ in whole_groups(batches, 1):
            fresh = np.concatenate([[True], now[0, 1:] != now[0, :-1]])
            hub = np.flatnonzero(fresh)[numbered(now, 1)]
            near = (now[1][hub] == 0) & (now[2] != now[2][hub])
            fps, place = np.unique(np.concatenate([now[2][near], now[2][hub[near]]]), return_inverse=True)
            labels = reduced(np.arange(len(fps)), *np.split(place, 2))
            other = np.flatnonzero(labels != np.arange(len(fps)))
            yield link_batch(fps[other], fps[labels[other]])

    return inner.unionByName(outer).repartition("key").sortWithinPartitions("key", "outer").mapInArrow(link, "a long, b long")


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def components(edges: DataFrame) -> DataFrame:
    """fp, root for each vertex of `edges` (a, b) but the roots, by alternating large and small stars; root is the smallest of the component."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("v").alias("fp"), F.col("u").alias("root"))
        before = now
        # No star makes more edges than there are edges and vertices.
        rows = 2 * now[0]
        edges = narrow(edges, rows)
        # Large star: all larger neighbours of v go to its smallest neighbour, or to v itself.
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = narrow(both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")), rows)
        large = cut(narrow(large.distinct(), rows))
        # Small star: v and all its smaller neighbours go to the smallest.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        edges = narrow(small.unionByName(least.select("v", F.col("m").alias("u"))), rows)
        edges = cut(narrow(edges.distinct(), rows))


def near_roots(docs: DataFrame, bits: int = MAX_BITS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None) -> DataFrame:
    """raw_hash and root of each different text: texts that links of near_groups reach have the same root."""
    prints = cut(fingerprints(docs, id_col, text_col, shingle).select("raw_hash", "fp").distinct())
    roots = components(links(prints.select("fp").distinct(), bits, blocks))
    return prints.join(roots, "fp", "left").select("raw_hash", F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame, bits: int = MAX_BITS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None) -> DataFrame:
    """One row per input row: doc_id, fingerprint, component_id, kept, raw_hash.

    Texts are linked if their fingerprints differ in at most `bits` bits; a
    component is all that links reach, and component_id the smallest doc_id in
    it (null ids aren't counted; null if there is no other). Of each component
    one row is kept: of the smallest doc_id, or of that row written first if the
    id repeats. Null and wordless texts have fingerprint zero.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("first")
    different = cut(prints.groupBy("fp").agg(first))
    roots = components(links(different.select("fp"), bits, blocks))
    classes = cut(different.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    firsts = classes.groupBy("root").agg(F.min("first").alias("first"))
    found = classes.select("fp", "root").join(firsts, "root").select("fp", "first")
    return prints.join(found, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
        (F.col("row_id") == F.col("first.row_id")).alias("kept"),
        "raw_hash",
    )


def drop_near_copies(docs: DataFrame, bits: int = MAX_BITS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each component."""
    return keep_rows(docs, near_groups(docs, bits, shingle, id_col, text_col), id_col, text_col)


def op5_simhash_near_dedup(spark, sf_dir):
    return near_groups(read(spark, sf_dir, "documents")).drop("kept", "raw_hash")
