"""Collapse of tags that differ by sequencing errors, and removal of tags seen in several genes."""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import hamming, neighbours
from .thinning import CLASSES, drawn, tag_hash

KEYS = ["seed", "frac_idx", "barcode", "gene"]
MOLECULES = "seed long, frac_idx int, frac double, barcode long, gene long, umi long, spliced long, unspliced long, ambiguous long, n_umis long"


def hamming_pairs(tags: DataFrame, length: int) -> DataFrame:
    """Pairs of tags of a barcode and gene one base apart, a below b: each tag asks for its neighbours by an equi-join."""
    asked = tags.select("barcode", "gene", F.col("umi").alias("umi_a"), F.explode(neighbours(F.col("umi"), length)).alias("umi_b")).where("umi_a < umi_b")
    return asked.join(tags.select("barcode", "gene", F.col("umi").alias("umi_b")), ["barcode", "gene", "umi_b"]).where(hamming(F.col("umi_a"), F.col("umi_b")) == 1)


def roots(group: np.ndarray, umi: np.ndarray, total: np.ndarray, length: int) -> np.ndarray:
    """For each tag its ancestor of best rank (most reads, then smallest number), along edges to tags one base apart with at most half the reads (and one half more)."""
    order = np.lexsort((umi, -total, group))
    group, umi, total = group[order], umi[order], total[order]
    a_parts, b_parts = [], []
    for place in range(length):
        masked = umi & ~(3 << 2 * place)
        by = np.lexsort((masked, group))
        for step in (1, 2, 3):
            x, y = by[:-step], by[step:]
            same = (group[x] == group[y]) & (masked[x] == masked[y])
            a_parts += [x[same], y[same]]
            b_parts += [y[same], x[same]]
    a, b = np.concatenate(a_parts), np.concatenate(b_parts)
    edge = total[a] >= 2 * total[b] - 1
    a, b = a[edge], b[edge]
    label = np.arange(len(umi))
    while True:
        before = label.copy()
        np.minimum.at(label, b, label[a])
        if np.array_equal(before, label):
            break
    out = np.empty(len(umi), np.int64)
    out[order] = order[label]
    return out


def directional(tags: DataFrame, length: int) -> DataFrame:
    """MOLECULES: tags (seed, frac_idx, frac, barcode, gene, umi and reads) collapsed to their ancestors.

    All rows of a barcode and gene, at most 4^length, meet in one task; a task
    works through its sorted rows in batches of whole groups.
    """

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in _and_end(batches):
            if batch is not None:
                now = pa.Table.from_batches([batch])
                rest = now if rest is None else pa.concat_tables([rest, now])
            if rest is None or not rest.num_rows:
                continue
            keys = np.stack([rest[k].to_numpy() for k in KEYS])
            change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            end = rest.num_rows if batch is None else int(change[-1]) if len(change) else 0
            if end:
                group = np.zeros(end, np.int64)
                group[change[change < end]] = 1
                yield from packed(rest.slice(0, end), np.cumsum(group))
                rest = rest.slice(end)

    def packed(rows: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        reads = np.stack([rows[c].to_numpy() for c in ("spliced", "unspliced", "ambiguous")])
        root = roots(group, rows["umi"].to_numpy(), reads.sum(0), length)
        sums = np.zeros((4, len(root)), np.int64)
        for i in range(3):
            np.add.at(sums[i], root, reads[i])
        np.add.at(sums[3], root, 1)
        own = np.flatnonzero(sums[3])
        kept = rows.select(["seed", "frac_idx", "frac", "barcode", "gene", "umi"]).take(pa.array(own))
        for i, name in enumerate(("spliced", "unspliced", "ambiguous", "n_umis")):
            kept = kept.append_column(name, pa.array(sums[i][own]))
        yield from kept.combine_chunks().to_batches()

    dealt = tags.select(*KEYS[:2], "frac", *KEYS[2:], "umi", "spliced", "unspliced", "ambiguous").repartition(*KEYS).sortWithinPartitions(*KEYS)
    return dealt.mapInArrow(collapse, MOLECULES)


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def uncollapsed(tags: DataFrame) -> DataFrame:
    """MOLECULES without correction: each tag is its own molecule."""
    return tags.select("seed", "frac_idx", "frac", "barcode", "gene", "umi", "spliced", "unspliced", "ambiguous", F.lit(1).cast("long").alias("n_umis"))


def mark_multi_gene(molecules: DataFrame) -> DataFrame:
    """Adds `valid`: of a barcode's molecules with the same tag, only one with strictly more reads than all others stays."""
    same = Window.partitionBy("seed", "frac_idx", "barcode", "umi")
    return (
        molecules.withColumn("total", F.col("spliced") + F.col("unspliced") + F.col("ambiguous"))
        .withColumn("__top", F.max("total").over(same))
        .withColumn("__tops", F.count_if(F.col("total") == F.col("__top")).over(same))
        .withColumn("valid", (F.col("total") == F.col("__top")) & (F.col("__tops") == 1))
        .drop("__top", "__tops")
    )


#: Tags of one seed with what they have at each fraction: `counts` are the fractions' reads of each class and tags, as `packed` numbers.
PACKED = "seed long, barcode long, gene long, umi long, counts binary"
VALUES = (*CLASSES, "n_umis")


def packed(numbers: np.ndarray) -> pa.Array:
    """Rows of numbers, none below 0, as bytes: all of one width, the least of 1, 2, 4 and 8 bytes that they fit in."""
    kind = np.min_scalar_type(numbers.max(initial=0))
    data = np.ascontiguousarray(numbers, kind)
    ends = np.arange(len(numbers) + 1, dtype=np.int32) * (data.shape[1] * kind.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(numbers), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def unpacked(rows: pa.ChunkedArray, width: int) -> np.ndarray:
    """The numbers of `packed`, `width` a row; rows may differ in their bytes."""
    found, at = np.empty((len(rows), width), np.int64), 0
    for chunk in rows.chunks:
        ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        data, sizes = np.frombuffer(chunk.buffers()[2], np.uint8), np.diff(ends) // width
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            taken = data[ends[0] : ends[-1]] if len(own) == len(chunk) else data[ends[own][:, None] + np.arange(size * width)]
            found[at + own] = taken.reshape(-1).view(f"u{size}").reshape(-1, width)
        at += len(chunk)
    return found


def whole_groups(keys: Sequence[str], work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of sorted batches that hands on rows of whole groups, with each row's group counted from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in _and_end(batches):
            if batch is not None and not batch.num_rows:
                continue
            last = None
            if batch is not None:
                # Where the last group of this batch starts; before that, whole groups end.
                marks = _starts(pa.Table.from_batches([batch]), keys)
                last = int(marks[-1])
                if last == 0 and rest and not _differ(rest[-1], batch, keys):
                    rest.append(batch)
                    continue
            done = rest if batch is None else [*rest, batch.slice(0, last)]
            rest = [] if batch is None else [batch.slice(last)]
            if rows := sum(b.num_rows for b in done):
                table = pa.Table.from_batches(done).combine_chunks()
                group = np.zeros(rows, np.int64)
                group[_starts(table, keys)[1:]] = 1
                yield from work(table, np.cumsum(group))

    return run


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """As whole numbers; null is the least."""
    return pc.fill_null(column, -(1 << 63)).to_numpy()


def _starts(rows: pa.Table, keys: Sequence[str]) -> np.ndarray:
    found = np.stack([_numbers(rows[k]) for k in keys])
    return np.r_[0, np.flatnonzero((found[:, 1:] != found[:, :-1]).any(0)) + 1]


def _differ(before: pa.RecordBatch, after: pa.RecordBatch, keys: Sequence[str]) -> bool:
    return any(before.column(k)[-1].as_py() != after.column(k)[0].as_py() for k in keys)


def close_pairs(group: np.ndarray, umi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Tags of a group one base apart, both ways; rows of a group lie together."""
    alone = np.bincount(group)[group] == 1
    rows = np.flatnonzero(~alone)
    group, umi = group[rows], umi[rows]
    a_parts, b_parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for place in range(length if len(rows) else 0):
        masked = umi & ~(3 << 2 * place)
        by = np.lexsort((masked, group))
        for step in (1, 2, 3):
            x, y = by[:-step], by[step:]
            same = (group[x] == group[y]) & (masked[x] == masked[y])
            a_parts += [rows[x[same]], rows[y[same]]]
            b_parts += [rows[y[same]], rows[x[same]]]
    return np.concatenate(a_parts), np.concatenate(b_parts)


def collapse_counts(values: np.ndarray, umi: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`values` (4, tags, fractions: reads of three classes and 1 for a tag with reads) with each tag's numbers added to its ancestor, as `roots` finds it, at every fraction; a and b from close_pairs."""
    total = values[:3].sum(0)
    pair, frac = np.nonzero((total[b] > 0) & (total[a] >= 2 * total[b] - 1)) if len(a) else (np.zeros(0, np.int64),) * 2
    if not len(pair):
        return values
    width = total.shape[1]
    nodes, ends = np.unique(np.concatenate([a[pair] * width + frac, b[pair] * width + frac]), return_inverse=True)
    tag, frac = np.divmod(nodes, width)
    order = np.lexsort((umi[tag], -total[tag, frac]))
    rank = np.empty(len(nodes), np.int64)
    rank[order] = np.arange(len(nodes))
    above, under = ends[: len(pair)], ends[len(pair) :]
    label = rank.copy()
    while True:
        before = label.copy()
        np.minimum.at(label, under, label[above])
        if np.array_equal(before, label):
            break
    root = order[label]
    gone = np.flatnonzero(root != np.arange(len(nodes)))
    for row in values:
        np.add.at(row, (tag[root[gone]], frac[gone]), row[tag[gone], frac[gone]])
        row[tag[gone], frac[gone]] = 0
    return values


def thinned_and_collapsed(tags: DataFrame, fracs: Sequence[float], seeds: Sequence[int], length: int | None) -> DataFrame:
    """PACKED: distinct tags thinned to all fractions, and collapsed to their ancestors if a length is given; `directional` of `thin` in one row for each seed and tag.

    The tags themselves are dealt by barcode and gene, once, and not their
    copies for each seed and fraction; which of them are one base apart is found once too.
    """
    grid = np.asarray(fracs, float)
    most = max(1, (1 << 23) // len(grid))

    def work(rows: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        umi = _numbers(rows["umi"])
        a, b = close_pairs(group, umi, length) if length is not None else (np.zeros(0, np.int64),) * 2
        reads = [rows[c].to_numpy() for c in CLASSES]
        for j, seed in enumerate(seeds):
            values = np.stack([drawn(rows[f"h{j}_{c}"].to_numpy(), n, grid) for c, n in zip(CLASSES, reads)] + [np.zeros((len(umi), len(grid)), np.int64)])
            values[3] = values[:3].sum(0) > 0
            values = collapse_counts(values, umi, a, b)
            own = np.flatnonzero(values[3].any(1))
            # A batch has at most 2^28 bytes of numbers.
            for part in np.split(own, range(most, len(own), most)):
                keys = [rows[k].combine_chunks().take(pa.array(part)) for k in ("barcode", "gene", "umi")]
                counts = packed(values[:, part].transpose(1, 0, 2).reshape(len(part), 4 * len(grid)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), seed, np.int64)), *keys, counts], ["seed", "barcode", "gene", "umi", "counts"])

    hashes = [tag_hash(int(s), c).alias(f"h{j}_{c}") for j, s in enumerate(seeds) for c in CLASSES]
    # Keys may be narrower numbers, of which hashes differ; they are hashed before they are widened.
    wide = [F.col(c).cast("long").alias(c) for c in ("barcode", "gene", "umi")] + [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in CLASSES]
    dealt = tags.repartition("barcode", "gene").sortWithinPartitions("barcode", "gene", "umi").select(*wide, *hashes)
    return dealt.mapInArrow(whole_groups(("barcode", "gene"), work), PACKED)


def with_validity(tags: DataFrame, fracs: Sequence[float], multi_gene: bool, tallied: bool = False) -> DataFrame:
    """MOLECULES of PACKED tags with total and valid, as of mark_multi_gene; or, tallied, n molecules of each seed, fraction, class, total and validity (a row for each batch that has some).

    Rows of the same barcode and tag meet in one task, a row for each gene and
    seed. Without `multi_gene` all are valid and nothing is dealt.
    """
    grid = np.asarray(fracs, float)
    names = ("seed", "barcode", "gene", "umi")

    def work(rows: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        counts = unpacked(rows["counts"], 4 * len(grid)).reshape(len(group), 4, len(grid))
        total = counts[:, :3].sum(1)
        there = counts[:, 3] > 0
        valid = there
        if multi_gene:
            first = np.flatnonzero(np.diff(group, prepend=-1))
            best = total == np.maximum.reduceat(total, first)[group]
            valid = best & (np.add.reduceat(best.astype(np.int64), first)[group] == 1)
        row, frac = np.nonzero(there)
        reads, valid, total = counts[row, :, frac], valid[row, frac], total[row, frac]
        if tallied:
            kind = np.where(reads[:, 0] > 0, 0, np.where(reads[:, 1] > 0, 1, 2))
            seeds, seed = np.unique(rows["seed"].to_numpy(), return_inverse=True)
            code = ((seed[row] * len(grid) + frac) * 3 + kind) * 2 + valid
            by = np.lexsort((total, code))
            code, total = code[by], total[by]
            at = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (total[1:] != total[:-1])]) if len(code) else by
            n = np.diff(at, append=len(code))
            code, total = code[at], total[at]
            part = [pa.array(seeds[code // (6 * len(grid))]), pa.array((code // 6 % len(grid)).astype(np.int32)), pa.array(np.asarray(CLASSES)[code // 2 % 3].tolist(), pa.string()), pa.array(total), pa.array(code % 2 == 1), pa.array(n)]
            yield pa.RecordBatch.from_arrays(part, ["seed", "frac_idx", "class", "total", "valid", "n"])
            return
        keys = {k: rows[k].take(pa.array(row)) for k in names}
        out = {"seed": keys["seed"], "frac_idx": pa.array(frac.astype(np.int32)), "frac": pa.array(grid[frac]), **{k: keys[k] for k in names[1:]}, **{c: pa.array(reads[:, i]) for i, c in enumerate(VALUES)}, "total": pa.array(total), "valid": pa.array(valid)}
        yield from pa.table(out).combine_chunks().to_batches(max_chunksize=100_000)

    kind = "seed long, frac_idx int, class string, total long, valid boolean, n long" if tallied else f"{MOLECULES}, total long, valid boolean"
    dealt = tags
    if multi_gene:
        dealt = tags.repartition("barcode", "umi").sortWithinPartitions("barcode", "umi", "seed")
    return dealt.mapInArrow(whole_groups(("barcode", "umi", "seed"), work), kind)
