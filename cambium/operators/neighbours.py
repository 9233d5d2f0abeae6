"""Near neighbours of all rows by inverted lists: cells around centres, of which each row looks at a few.

Centres are fitted on a sample of bounded size; every row is in the list of its
nearest centre. How many lists a row has to look at is measured rather than
guessed: the exact neighbours of a few hundred rows are found by one scan, and
the number of lists is the least that holds the asked share of them. A list
that is too long is dealt to parts. Rows of a part come first and then the rows
that look at it, which stream past in Arrow batches, so what is shuffled grows
with rows times lists looked at, and a task holds one part. Rows that look at a
quarter of all lists or more are compared with all, which meet them in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept

#: Rows of a list, about; lists at most; rows of the sample for each; rows whose exact neighbours are found.
LIST_ROWS, MAX_LISTS, SAMPLE, PROBED = 2048, 4096, 32, 256
ITERATIONS = 6
#: Points that are compared at once; pairs that are measured at once.
TILE, MEASURED = 2048, 1 << 16
#: Rows of a block that all rows are compared with, about.
BLOCK = 32_768


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.empty((0, 0))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x and y, up to rounding."""
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0)


def exact_best(x: np.ndarray, own: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the row of x, id and squared distance of its k nearest points but itself; ties by id.

    Candidates are chosen by the quick formula, tile by tile, with what rounding
    may hide, and measured exactly; a tile is left out by the k-th best so far.
    """
    slack = 1e-9 * ((x**2).sum(1) + (points**2).sum(1).max(initial=0.0)) + 1e-12
    norms, own_norms = (points**2).sum(1), (x**2).sum(1)
    best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    edge = np.full(len(x), np.inf)
    for start in range(0, len(ids), TILE):
        some = ids[start : start + TILE]
        quick = x @ (-2 * points[start : start + TILE]).T
        quick += norms[start : start + TILE]
        quick += own_norms[:, None]
        if not np.isfinite(edge).all() and len(some) > k:
            # k + 1, for a row may meet itself.
            edge = np.minimum(edge, np.partition(quick, k, 1)[:, k])
        row, at = np.divmod(np.flatnonzero(quick <= (edge + slack)[:, None]), len(some))
        real = own[row] != some[at]
        row, at = row[real], at[real]
        for i in range(0, len(row), MEASURED):
            r, t = row[i : i + MEASURED], at[i : i + MEASURED] + start
            found = (np.concatenate(c) for c in zip(best, (r, ids[t], ((x[r] - points[t]) ** 2).sum(1)), strict=True))
            best = first_of(*found, k)
        place = np.searchsorted(best[0], np.arange(len(x)), "right") - 1
        full = np.bincount(best[0], minlength=len(x)) >= k
        edge[full] = np.minimum(edge[full], best[2][place[full]])
    return best


def first_of(row: np.ndarray, other: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k least of each row, by distance and then id."""
    order = np.lexsort((other, d, row))
    row, other, d = row[order], other[order], d[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], other[keep], d[keep]


def enough(ids: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Finite points and their ids without those that can't be returned: of equal points the k + 1 of least id stay."""
    order = np.argsort(ids, kind="stable")
    order = order[np.isfinite(points[order]).all(1)]  # others are at no distance
    ids, points = ids[order], np.ascontiguousarray(points[order])
    if not points.size:
        return ids, points
    same = np.unique(points.view(np.dtype((np.void, points.shape[1] * points.itemsize))).ravel(), return_inverse=True)[1]
    order = np.argsort(same, kind="stable")
    same = same[order]
    keep = np.sort(order[np.arange(len(same)) - np.searchsorted(same, same) <= k])
    return ids[keep], points[keep]


def visitor(k: int):
    """Of rows sorted by key and kind (key, kind, id, vec): id, other and d2 of the k nearest points, kind 0, of the same key of each row of kind 1. A task holds the points of one key."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, points = None, [], None
        for batch in batches:
            keys, kinds, ids = (batch.column(i).to_numpy() for i in range(3))
            turns = np.flatnonzero((np.diff(keys) != 0) | (np.diff(kinds) != 0)) + 1
            for start, end in zip([0, *turns], [*turns, len(keys)], strict=True):
                if start == end:
                    continue
                if keys[start] != at:
                    at, held, points = keys[start], [], None
                own, x = ids[start:end], matrix(batch.column(3).slice(start, end - start))
                if not kinds[start]:
                    held.append((own, x))
                    continue
                if points is None and held:
                    points, held = enough(*(np.concatenate(c) for c in zip(*held, strict=True)), k), []
                if points is None:
                    continue
                for i in range(0, len(own), 512):
                    row, other, d = exact_best(x[i : i + 512], own[i : i + 512], points[1], points[0], k)
                    yield pa.RecordBatch.from_arrays([pa.array(own[i : i + 512][row]), pa.array(other), pa.array(d)], ["id", "other", "d2"])

    return visit


def centres_of(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centres by Lloyd's iterations over the sample; the first ones are spread over its rows."""
    centres = sample[np.linspace(0, len(sample) - 1, lists).astype(int)]
    for _ in range(ITERATIONS):
        near = squared(sample, centres).argmin(1)
        n = np.bincount(near, minlength=lists)
        sums = np.stack([np.bincount(near, column, lists) for column in sample.T], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class ListIndex:
    """Rows (id, vec) in lists. `probes` may be given; else it is the least that holds `recall` of the exact neighbours of PROBED rows."""

    def __init__(self, vectors: DataFrame, k: int, recall: float = 0.95, probes: int | None = None, list_rows: int = LIST_ROWS):
        self.k, self.list_rows = k, list_rows
        rows = kept(vectors.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")))
        count = rows.count()
        lists = max(1, min(MAX_LISTS, math.ceil(count / list_rows)))
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * lists).toArrow()["vec"].combine_chunks()  # SAMPLE * MAX_LISTS at most
        self.centres = centres_of(matrix(sample), lists) if count else np.zeros((1, 1))
        self.rows = self._listed(rows)
        self.probes = min(lists, probes if probes is not None else self._probes(recall))

    def _listed(self, rows: DataFrame) -> DataFrame:
        """key, id and vec; keys number the lists and, of long ones, their parts."""
        centres = self.centres

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = squared(matrix(batch.column(1)), centres).argmin(1) if batch.num_rows else []
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *batch.columns], ["list", "id", "vec"])

        listed = kept(rows.mapInArrow(near, "list long, id long, vec array<double>"))
        sizes = {r["list"]: r["count"] for r in listed.groupBy("list").count().collect()}  # MAX_LISTS at most
        parts = [max(1, math.ceil(sizes.get(c, 0) / (2 * self.list_rows))) for c in range(len(centres))]
        base = np.cumsum([0, *parts])
        self.keys = int(base[-1])
        self.parts = F.broadcast(rows.sparkSession.createDataFrame([(c, int(base[c]), n) for c, n in enumerate(parts)], "list long, base long, parts int"))
        return listed.join(self.parts, "list").select((F.col("base") + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("key"), "list", "id", "vec")

    def _probes(self, recall: float) -> int:
        """The least number of lists that holds `recall` of the exact neighbours of PROBED rows."""
        asked = self.rows.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(PROBED).select("id", "vec").toArrow()
        if not asked.num_rows:
            return 1
        own, x, k, centres = asked["id"].to_numpy(), matrix(asked["vec"].combine_chunks()), self.k, self.centres

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists, ids, points = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2))
                if not len(ids):
                    continue
                row, other, d = exact_best(x, own, points, ids, k)
                at = dict(zip(ids.tolist(), lists.tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(other), pa.array(d), pa.array([at[o] for o in other.tolist()], pa.int64())], ["row", "other", "d2", "list"])

        found = best_of(self.rows.select("list", "id", "vec").mapInArrow(scan, "row long, other long, d2 double, list long"), "row", k)
        true = found.select("row", "list").toArrow()  # PROBED * k at most
        if not true.num_rows:
            return 1
        order = squared(x, centres).argsort(1, kind="stable").argsort(1)
        ranks = np.sort(order[true["row"].to_numpy(), true["list"].to_numpy()])
        return int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)) - 1)]) + 1

    def nearest(self) -> DataFrame:
        """id, other, d2 and place (from 1) of the k nearest other rows that each row finds in its lists."""
        centres, probes, k = self.centres, self.probes, self.k
        if 4 * probes >= len(centres):
            # So many lists would be dealt a copy of each row: lists meet all rows in blocks instead.
            wide = max(1, BLOCK // (2 * self.list_rows))
            return against_blocks(self.rows.select("id", "vec", F.floor(F.col("key") / wide).cast("int").alias("block")), -(-self.keys // wide), k)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = np.argpartition(squared(matrix(batch.column(1)), centres), probes - 1, 1)[:, :probes] if batch.num_rows else np.empty((0, probes), np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * probes, pa.int32()), pa.array(near.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["id", "vec", "lists"])

        asked = self.rows.select("id", "vec").mapInArrow(ask, "id long, vec array<double>, lists array<long>")
        dealt = asked.withColumn("list", F.explode("lists")).join(self.parts, "list")
        dealt = dealt.withColumn("key", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("parts") - 1))).select("key", F.lit(1).alias("kind"), "id", "vec")

        both = self.rows.select("key", F.lit(0).alias("kind"), "id", "vec").unionByName(dealt)
        met = both.repartitionById(self.keys, F.col("key").cast("int")).sortWithinPartitions("key", "kind").mapInArrow(visitor(k), "id long, other long, d2 double")
        return best_of(met, "id", k)


def against_blocks(rows: DataFrame, blocks: int, k: int) -> DataFrame:
    """id, other, d2 and place of the k nearest other rows of each row (id, vec, block), all of them compared: a row is dealt once to each block, and the rows that ask to parts, for there to be enough tasks."""
    parts = -(-3 * rows.sparkSession.sparkContext.defaultParallelism // blocks)
    points = rows.withColumn("key", F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: (F.col("block") * parts + i).cast("int"))))
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int")
    asked = rows.withColumn("key", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: (b * parts + part).cast("int"))))
    both = points.select("key", F.lit(0).alias("kind"), "id", "vec").unionByName(asked.select("key", F.lit(1).alias("kind"), "id", "vec"))
    return best_of(both.repartitionById(blocks * parts, F.col("key")).sortWithinPartitions("key", "kind").mapInArrow(visitor(k), "id long, other long, d2 double"), "id", k)


def best_of(found: DataFrame, key: str, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy("d2", "other"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def near_neighbours(vectors: DataFrame, k: int, recall: float = 0.95, probes: int | None = None, list_rows: int = LIST_ROWS) -> DataFrame:
    """id, other, d2 and place of about the k nearest other rows of each row (id, vec), of which `recall` are expected to be exact.

    Distances are exact; ties go to the smaller id. Ids are unique longs, all
    vectors of one length. Rows with a null id or vector take no part; an empty
    table gives no rows. With as many probes as lists the result is exact.
    """
    return ListIndex(vectors, k, recall, probes, list_rows).nearest()


def recall_of(found: DataFrame, true: DataFrame) -> DataFrame:
    """One row: pairs (id, other) that are true, found and true, and their share."""
    both = true.select("id", "other").join(found.select("id", "other", F.lit(1).alias("hit")), ["id", "other"], "left")
    return both.agg(F.count(F.lit(1)).alias("pairs"), F.count("hit").alias("found")).withColumn("recall", F.col("found") / F.col("pairs"))
