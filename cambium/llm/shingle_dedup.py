"""Near-duplicates by Jaccard similarity of word shingles: candidates by bands of MinHash values, then verified exactly and connected.

With 48 bands of 6 values, a pair of similarity 0.8 shares no band with a
chance below 5 * 10^-7, and less above. Bands only propose pairs: first of each
text with the least one of its band, then of texts that are still apart with
another one, so a large group of copies costs about as many pairs as it has
texts. Last, texts of one band that are of different components are compared:
in bands of few texts as pairs, in others by tasks that hold the texts of two
blocks each and send on only what is similar. Before shingles are compared, pairs are
discarded whose sketches, one bit of each of 256 MinHash values, differ in more
bits than those of a pair of the least similarity do with a chance of 10^-5.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, cut, keep_rows, maybe_in, narrow, sliced, utf8
from .simhash import SEED, components

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 48, 6
#: Texts of a band that meet as pairs, at most.
PAIR_GROUP = 16
#: Texts of a block: a task holds the shingles of two blocks.
CELL = 512
#: Longs of a sketch.
SKETCH = 4


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted different hashes of a text's shingles; a text of fewer words, but not none, is one shingle."""
    words = text.translate(ASCII_LOWER).split() if text else []
    if len(words) < shingle:
        shingles = iter([b" ".join(words)] if words else [])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64))


def multipliers() -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 63, (2, BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def bands_of(hashes: np.ndarray, factors: np.ndarray) -> tuple[list[int], np.ndarray]:
    """A 64-bit hash of each band's place and its least values, and the sketch: bit 20 of each least value."""
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (factors[0] * hashes[at : at + 1024] + factors[1]).min(1))
    data, width = least.tobytes(), 8 * ROWS
    bands = [xxhash.xxh3_64_intdigest(data[i * width : (i + 1) * width], i) for i in range(BANDS)] if len(hashes) else []
    return bands, np.packbits((least[: 64 * SKETCH] >> np.uint64(20) & np.uint64(1)).astype(bool)).view(np.int64)


def signed(values: list[int]) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


def signatures(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """row_id, doc_id, raw_hash (of the text), node (a hash of the shingle set), n (its size), bands and sketch of each row."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("raw_hash"), F.col(text_col).alias("text"))

    def signed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = multipliers()
        for batch in sliced(batches, 3):
            sets = [shingle_set(t, shingle) for t in utf8(batch.column(3))]
            nodes = signed([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets])
            bands, sketches = zip(*(bands_of(s, factors) for s in sets), strict=True)
            added = [pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(signed, bands), pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *added], ["row_id", "doc_id", "raw_hash", "node", "n", "bands", "sketch"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(signed_rows, f"row_id long, doc_id {kind}, raw_hash long, node long, n long, bands array<long>, sketch array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int, text_col: str) -> DataFrame:
    """node and its shingles' hashes, of `wanted` (node, raw_hash)."""
    hashed = docs.select(F.xxhash64(text_col).alias("raw_hash"), F.col(text_col).alias("text"))
    # One of equal texts, before any shuffle of them.
    once = maybe_in(hashed, F.col("raw_hash"), wanted, "raw_hash").where("__maybe").select("raw_hash", "text").dropDuplicates(["raw_hash"])
    texts = once.join(wanted, "raw_hash").select("node", "text")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            sets = pa.array([shingle_set(t, shingle).view(np.int64) for t in utf8(batch.column(1))], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["node", "shingles"])

    return texts.mapInArrow(shingled, "node long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs a, b whose shingle sets have a Jaccard similarity of `least` or more."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    common = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("c"), (F.size("sa") + F.size("sb")).alias("all"))
    return common.where(F.col("c") / (F.col("all") - F.col("c")) >= least).select("a", "b")


def similar_in_cells(left: DataFrame, nodes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The similar pairs a, b of texts of one band (key, node, n, root, size) that are of different components.

    A pair is compared in the first of the bands that it shares only.
    """
    parts = F.ceil(F.col("size") / CELL).cast("int")
    block = F.pmod(F.xxhash64("node", F.lit(1)), parts).cast("int")
    dealt = left.select("key", "node", "n", "root", block.alias("block"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    cells = dealt.withColumn("cell", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
    # What a text brings is put together once, so it is dealt twice only: to its node and to its cells.
    brought = cut(sets.join(left.select("node").distinct(), "node").join(nodes.select("node", "bands", "sketch"), "node"))
    cells = cells.join(brought, "node")
    most = most_bits(least)

    def compare(rows: pa.Table) -> pa.Table:
        node, n, root, block, other, key = (rows[name].to_numpy() for name in ("node", "n", "root", "block", "other", "key"))
        bands, sketch = (np.stack([np.asarray(x, np.int64) for x in rows[name].to_pylist()]) for name in ("bands", "sketch"))
        sketch = sketch.view(np.uint64)
        shingles = [np.asarray(x, np.int64) for x in rows["shingles"].to_pylist()]
        found = []
        for i in range(len(node)):
            # Of one block, or of the two blocks of the cell; each pair once.
            j = np.flatnonzero((node > node[i]) & (root != root[i]) & (key == key[i]) & (block == other[i]) & (np.minimum(n, n[i]) >= least * np.maximum(n, n[i])))
            j = j[np.bitwise_count(sketch[j] ^ sketch[i]).sum(1) <= most]
            same = bands[j] == bands[i]
            j = j[np.where(same, bands[j], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max) == key[i]]
            own = np.sort(shingles[i])
            for k in j.tolist():
                common = np.count_nonzero(own[np.minimum(np.searchsorted(own, shingles[k]), len(own) - 1)] == shingles[k])
                if common >= least * (len(own) + len(shingles[k]) - common):
                    found.append((node[i], node[k]))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.groupBy("cell").applyInArrow(compare, "a long, b long")


def most_bits(least: float) -> int:
    """Bits in which the sketches of a pair of this similarity differ, at most: five standard deviations over the mean."""
    bits, share = 64 * SKETCH, (1 - least) / 2
    return int(bits * share + 5 * (bits * share * (1 - share)) ** 0.5)


def close(sketch, other, least: float):
    """Whether two sketches differ in few enough bits for this similarity."""
    return sum((F.bit_count(sketch[i].bitwiseXOR(other[i])) for i in range(SKETCH)), F.lit(0)) <= most_bits(least)


def similar(n, other, least: float):
    """Whether sets of these sizes can be similar at all."""
    return F.least(n, other) / F.greatest(n, other) >= least


def similar_roots(nodes: DataFrame, docs: DataFrame, least: float, shingle: int, text_col: str) -> DataFrame:
    """fp, root of each of `nodes` (node, n, raw_hash, bands, sketch) that is linked with a smaller one; root is the smallest of the component."""
    keyed = nodes.select("node", "n", F.explode("bands").alias("key"))
    lowest = keyed.groupBy("key").agg(F.min(F.struct("node", "n")).alias("low"), F.max("node").alias("last"))
    lowest = cut(lowest.where("low.node <> last").select("key", F.col("low.node").alias("low"), F.col("low.n").alias("low_n")))
    shared = cut(maybe_in(keyed, F.col("key"), lowest, "key").where("__maybe").join(lowest, "key").select("key", "node", "n", "low", "low_n"))
    wanted = nodes.select("node", "raw_hash").join(shared.select("node").distinct(), "node")
    # Dealt by node once: later joins by node leave the sets where they are.
    sets = cut(shingle_sets(docs, wanted, shingle, text_col).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node"))
    sketches = narrow(nodes.select("node", "sketch"), nodes.count())
    size = shared.count()
    others = narrow(shared, size).where(F.col("node") != F.col("low"))

    def found(pairs: DataFrame, rows: int) -> DataFrame:
        """The similar ones of at most `rows` pairs a, b, which may come several times."""
        some = narrow(narrow(pairs, rows).distinct(), rows)
        both = narrow(some.join(sketches.toDF("a", "sketch_a"), "a"), rows).join(sketches.toDF("b", "sketch_b"), "b")
        near = narrow(both.where(close(F.col("sketch_a"), F.col("sketch_b"), least)).select("a", "b"), rows)
        return cut(narrow(verified(near, sets, least), rows))

    def apart() -> DataFrame:
        """key, node, n, root of the texts of bands that aren't all of one component, but for the least of each."""
        placed = narrow(others.select("key", "node", "n").join(roots.withColumnRenamed("fp", "node"), "node", "left").withColumn("root", F.coalesce("root", "node")), size)
        mixed = placed.groupBy("key").agg(F.min("root").alias("one"), F.max("root").alias("other")).where("one <> other").select("key")
        return cut(narrow(placed.join(mixed, "key"), size))

    links = found(others.where(similar(F.col("n"), F.col("low_n"), least)).select(F.col("node").alias("a"), F.col("low").alias("b")), size)
    roots = cut(components(links))
    left = apart()
    hubs = left.groupBy("key").agg(F.min_by(F.struct("node", "n", "root"), F.xxhash64("node", "key")).alias("hub"))
    stars = left.join(hubs, "key").where(F.col("root") != F.col("hub.root")).where(similar(F.col("n"), F.col("hub.n"), least))
    more = found(stars.select(F.col("node").alias("a"), F.col("hub.node").alias("b")), size)
    if not more.isEmpty():
        links = links.unionByName(more)
        roots = cut(components(links))
        left = apart()
    left = cut(narrow(left.join(left.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "key"), size))
    few = left.where(F.col("size") <= PAIR_GROUP)
    one, other = (few.select("key", F.struct("node", "n", "root").alias(name)) for name in "ab")
    met = one.join(other, "key").where((F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root")) & similar(F.col("a.n"), F.col("b.n"), least))
    more = found(met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")), PAIR_GROUP * size)
    many = left.where(F.col("size") > PAIR_GROUP)
    if not many.isEmpty():
        more = cut(more.unionByName(similar_in_cells(many, nodes, sets, least)))
    return roots if more.isEmpty() else cut(components(links.unionByName(more)))


def joined_roots(roots: DataFrame, prints: DataFrame, near: DataFrame) -> DataFrame:
    """`roots` (fp, root) of nodes, with those connected too that texts of one root of `near` (raw_hash, root) have."""
    named = cut(prints.select("raw_hash", "node").distinct().join(near, "raw_hash").select("node", "root").distinct())
    least = named.groupBy("root").agg(F.min("node").alias("low"))
    extra = named.join(least, "root").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    return cut(components(roots.select(F.col("fp").alias("a"), F.col("root").alias("b")).unionByName(extra)))


def similar_groups(docs: DataFrame, least: float = LEAST, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", near: DataFrame | None = None) -> DataFrame:
    """One row per input row: doc_id, component_id, kept, raw_hash.

    Texts are linked if their sets of shingles (words parted by white space,
    A-Z lower-cased) have a Jaccard similarity of `least` or more; components
    and the row kept of each are those of simhash.near_groups. Texts with equal
    sets are linked, null and wordless ones too. Equal 64-bit hashes count as
    equal shingles and sets. Texts that have a root of `near` (raw_hash, root:
    simhash.near_roots) in common are linked as well.
    """
    prints = cut(signatures(docs, shingle, id_col, text_col))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("first")
    nodes = cut(prints.select("node", "n", "raw_hash", "bands", "sketch").dropDuplicates(["node"]))
    roots = similar_roots(nodes, docs, least, shingle, text_col)
    if near is not None:
        roots = joined_roots(roots, prints, near)
    classes = cut(prints.groupBy("node").agg(first).join(roots.withColumnRenamed("fp", "node"), "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")))
    firsts = classes.groupBy("root").agg(F.min("first").alias("first"))
    found = classes.select("node", "root").join(firsts, "root").select("node", "first")
    return prints.join(found, "node").select("doc_id", F.col("first.doc_id").alias("component_id"), (F.col("row_id") == F.col("first.row_id")).alias("kept"), "raw_hash")


def drop_similar(docs: DataFrame, least: float = LEAST, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", near: DataFrame | None = None) -> DataFrame:
    """`docs` with one row of each component."""
    return keep_rows(docs, similar_groups(docs, least, shingle, id_col, text_col, near), id_col, text_col)
