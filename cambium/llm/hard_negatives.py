"""Hard negatives by a vantage-point tree over norm-augmented vectors.

With one more component, sqrt(top - |x|^2), all rows lie on a sphere, and the
squared distance of an anchor a (with 0 there) to a row x is |a|^2 + top - 2 a.x:
the larger the inner product, the nearer the row, and a window of scores is an
annulus around the anchor. Vantage points bound the distances of what is below
them, so the tree is walked nearest first inside the annulus, each leaf being
scored (exactly, in integers) only when it is reached, until k rows have been
found that nothing unvisited can precede.

The upper part of the tree is fitted on a sample of bounded size and deals all
rows to cells of bounded size; the lower part is built inside the task that
has a cell, and anchors stream past it. An anchor goes to the cell of its own
place first; what it finds there bounds the annulus for the other cells, and
only cells that the annulus meets are asked at all. Of rows equal in label and
vector only the first few by id can be returned, so the others (a third of the
table, perhaps) are cut off before they reach one cell.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, read

POSITIVES, NEGATIVES = 5, 10
#: The window of negatives, in hundredths of the positive's score.
LOW, HIGH = 30, 90
#: Components are multiplied by this and rounded down.
SCALE = 256
#: Rows of a cell, about; cells at most, beyond which each is dealt in parts; rows of the sample for each cell.
CELL_ROWS, MAX_CELLS, SAMPLE = 8192, 2048, 32
LEAF = 128
LEAST, MOST = -(1 << 63), (1 << 63) - 1
WINDOWS = "array<struct<w:bigint,low:bigint,high:bigint,least:bigint>>"
#: Results held by a task before it sends them on.
HELD = 20_000


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """id, label and vector (whole numbers) of the rows that take part, written once. A null id counts as the largest."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    vector = F.col(vector_col)
    fit = rows.where(F.col(label_col).isNotNull() & vector.isNotNull()).where(~F.exists(vector, bad))
    return cut(fit.select(F.coalesce(F.col(id_col).cast("long"), F.lit(MOST)).alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("vector")))


def matrix(column: pa.Array, dim: int, limit: int) -> np.ndarray:
    """A list column as rows of `dim` whole numbers; what is short is filled with zeros. Doubles if inner products of them are exact, else longs."""
    kind = np.float64 if dim * limit**2 < 1 << 53 else np.int64
    flat, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    flat = flat[starts[0] : starts[-1]]
    if len(flat) == dim * len(column) and (np.diff(starts) == dim).all():
        return flat.reshape(-1, dim).astype(kind)
    out = np.zeros((len(column), dim), kind)
    lengths = np.diff(starts)
    at = np.repeat(np.arange(len(column)), lengths)
    out[at, np.arange(len(flat)) - np.repeat(starts[:-1] - starts[0], lengths)] = flat
    return out


class Sphere:
    """Distances of rows, raised to the sphere of squared radius `top`, and of anchors, which aren't."""

    def __init__(self, top: float):
        self.top = max(float(top), 1.0)
        self.slack = 1e-6 * math.sqrt(self.top)

    def raised(self, rows: np.ndarray) -> np.ndarray:
        rows = rows.astype(float)
        return np.concatenate([rows, np.sqrt(np.maximum(self.top - (rows**2).sum(1, keepdims=True), 0))], 1)

    def apart(self, raised: np.ndarray, vantage: np.ndarray) -> np.ndarray:
        """Distances on the sphere; vantage is one row or one for each."""
        return np.sqrt(np.maximum(2 * self.top - 2 * (raised * vantage).sum(-1), 0))

    def from_anchor(self, anchor: np.ndarray, norm: float, vantages: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(norm + self.top - 2 * (vantages[:, :-1] @ anchor), 0))

    def score_at(self, distance, norm):
        """The score of a row at this distance."""
        return (norm + self.top - distance**2) / 2

    def bounds(self, nearest, furthest, norm):
        """The lowest and highest score of rows between two distances, safe against rounding."""
        slack = 1e-9 * (norm + self.top) + 0.25
        return self.score_at(furthest + self.slack, norm) - slack, self.score_at(np.maximum(nearest - self.slack, 0), norm) + slack


def far_point(raised: np.ndarray) -> np.ndarray:
    """A row far from the others' middle: distances to it spread more."""
    return raised[((raised - raised.mean(0)) ** 2).sum(1).argmax()]


class Router:
    """The upper part of the tree: a complete binary tree whose leaves are the cells."""

    def __init__(self, sample: np.ndarray, depth: int, sphere: Sphere):
        self.depth, self.sphere = depth, sphere
        self.vantages = np.zeros((max((1 << depth) - 1, 1), sample.shape[1] + 1))
        self.radii = np.zeros(len(self.vantages))
        held = {0: sphere.raised(sample)}
        for node in range((1 << depth) - 1):
            rows = held.pop(node)
            if not len(rows):
                held[2 * node + 1] = held[2 * node + 2] = rows
                continue
            self.vantages[node] = far_point(rows)
            away = sphere.apart(rows, self.vantages[node])
            self.radii[node] = np.median(away)
            held[2 * node + 1], held[2 * node + 2] = rows[away <= self.radii[node]], rows[away > self.radii[node]]

    def cells(self, rows: np.ndarray) -> np.ndarray:
        raised, node = self.sphere.raised(rows), np.zeros(len(rows), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (self.sphere.apart(raised, self.vantages[node]) > self.radii[node])
        return node - (len(self.vantages) if self.depth else 0)

    def met(self, anchor: np.ndarray, norm: float, windows: list[tuple[int, int]]) -> np.ndarray:
        """The cells that may hold a row whose score is in one of the windows."""
        away = self.sphere.from_anchor(anchor, norm, self.vantages)
        near, far = np.zeros(1), np.full(1, math.sqrt(norm) + math.sqrt(self.sphere.top))
        for level in range(self.depth):
            at = slice((1 << level) - 1, (2 << level) - 1)
            d, r = away[at], self.radii[at]
            near = np.stack([np.maximum(near, d - r - self.sphere.slack), np.maximum(near, r - d - self.sphere.slack)], 1).ravel()
            far = np.stack([np.minimum(far, d + r + self.sphere.slack), far], 1).ravel()
        low, high = self.sphere.bounds(near, far, norm)
        return np.flatnonzero(np.any([(low <= b) & (high >= a) for a, b in windows], axis=0)) if windows else np.empty(0, np.int64)


class Tree:
    """The part of the tree below a cell."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, sphere: Sphere):
        self.sphere, raised = sphere, sphere.raised(vectors)
        vantages, self.nodes, self.leaves = [], [], []

        def build(rows: np.ndarray) -> int:
            at = len(self.nodes)
            self.nodes.append(None)
            if len(rows) <= LEAF:
                self.nodes[at] = ~len(self.leaves)
                self.leaves.append((ids[rows], labels[rows], vectors[rows]))
                return at
            vantage = far_point(raised[rows])
            away = sphere.apart(raised[rows], vantage)
            order = np.argsort(away, kind="stable")
            number, half = len(vantages), len(rows) // 2
            vantages.append(vantage)
            parts = [order[:half], order[half:]]
            self.nodes[at] = (number, [(float(away[p[0]]), float(away[p[-1]]), build(rows[p])) for p in parts])
            return at

        build(np.arange(len(ids)))
        self.vantages = np.asarray(vantages).reshape(-1, raised.shape[1])

    def search(self, anchor: np.ndarray, label: int, windows: list[tuple[int, int, int, int]], same: bool, k: int) -> Iterator[tuple[int, int, int]]:
        """(w, score, id) of the first k rows of each window (w, low, high, least) that may count, those below `least` left out."""
        norm = float((anchor.astype(float) ** 2).sum())
        away = self.sphere.from_anchor(anchor.astype(float), norm, self.vantages).tolist()
        scored: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w, low, high, least in windows:
            floor, found = max(low, least), 0
            heap: list[tuple] = [(-math.inf, 0, 0, 0.0, math.sqrt(norm) + math.sqrt(self.sphere.top))]
            while heap and found < k:
                key, kind, at, *within = heapq.heappop(heap)
                if -key < floor:
                    break
                if kind:
                    yield w, int(-key), at
                    found += 1
                    continue
                node = self.nodes[at]
                if isinstance(node, int):
                    leaf = ~node
                    if leaf not in scored:
                        ids, labels, vectors = self.leaves[leaf]
                        of = (labels == label) == same
                        scored[leaf] = (vectors[of] @ anchor).astype(np.int64), ids[of]
                    scores, ids = scored[leaf]
                    chosen = np.flatnonzero((scores >= floor) & (scores <= high))
                    if len(chosen) > k:
                        chosen = chosen[np.lexsort((ids[chosen], -scores[chosen]))[:k]]
                    for score, id_ in zip(scores[chosen].tolist(), ids[chosen].tolist(), strict=True):
                        heapq.heappush(heap, (-score, 1, id_))
                    continue
                number, children = node
                for inner, outer, child in children:
                    near, far = max(within[0], away[number] - outer, inner - away[number]), min(within[1], away[number] + outer)
                    lowest, highest = self.sphere.bounds(near, far, norm)
                    if lowest <= high and highest >= floor:
                        heapq.heappush(heap, (-min(float(highest), float(high)), 0, child, near, far))


class Index:
    """All usable rows in cells. `keep` copies of rows equal in label and vector can ever be asked for."""

    def __init__(self, rows: DataFrame, keep: int, cell_rows: int = CELL_ROWS):
        dim = max(rows.agg(F.max(F.size("vector"))).first()[0] or 0, 1)
        self.dim, self.limit, self.cell_rows = dim, math.isqrt((1 << 62) // dim), cell_rows
        alike = Window.partitionBy("label", "vector").orderBy("id")
        self.points = cut(self.clipped(rows).withColumn("__copy", F.row_number().over(alike)).where(F.col("__copy") <= keep).drop("__copy"))
        size = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
        count, top = self.points.agg(F.count(F.lit(1)), F.max(size)).first()
        self.sphere = Sphere(top or 0.0)
        depth = max(0, min(math.ceil(math.log2(max(count / cell_rows, 1))), int(math.log2(MAX_CELLS))))
        # At most SAMPLE rows for each of MAX_CELLS cells.
        sample = self.points.orderBy(F.xxhash64("id"), "id").limit(SAMPLE << depth).select("vector").toArrow()["vector"].combine_chunks()
        self.router = Router(matrix(sample, dim, self.limit), depth, self.sphere)
        self.placed = self._placed()

    def clipped(self, rows: DataFrame) -> DataFrame:
        """Components beyond the limit that keeps scores within a long count as the limit."""
        return rows.withColumn("vector", F.transform("vector", lambda x: F.greatest(F.lit(-self.limit), F.least(F.lit(self.limit), x))))

    def _placed(self) -> DataFrame:
        """key, id, label, vector: a key is a cell, or a part of one that has more rows than twice `cell_rows`; keys are numbered from 0."""
        router, dim, limit = self.router, self.dim, self.limit

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = router.cells(matrix(batch.column(2), dim, limit)) if batch.num_rows else []
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), *batch.columns], ["cell", "id", "label", "vector"])

        placed = cut(self.points.mapInArrow(place, "cell long, id long, label long, vector array<long>"))
        sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # MAX_CELLS at most
        parts = [max(1, math.ceil(sizes.get(cell, 0) / (2 * self.cell_rows))) for cell in range(1 << router.depth)]
        base = np.cumsum([0, *parts])
        self.keys = int(base[-1])
        table = [(cell, int(base[cell]), n) for cell, n in enumerate(parts)]
        self.parts = F.broadcast(placed.sparkSession.createDataFrame(table, "cell long, base long, parts int"))
        return placed.join(self.parts, "cell").withColumn("key", F.col("base") + F.pmod(F.xxhash64("id", "label"), F.col("parts"))).select("key", "id", "label", "vector")

    def _asked(self, anchors: DataFrame, home: bool) -> DataFrame:
        """The anchors, a row for each key that they have to look at: those of their own cell, or all others that their windows meet."""
        router, dim, limit = self.router, self.dim, self.limit

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = matrix(batch.column(2), dim, limit) if batch.num_rows else np.empty((0, dim))
                own, cells = router.cells(vectors), []
                for vector, cell, windows in zip(vectors.astype(float), own.tolist(), batch.column(3).to_pylist(), strict=True):
                    met = router.met(vector, float((vector**2).sum()), [(max(w["low"], w["least"]), w["high"]) for w in windows])
                    cells.append([cell] if home else [c for c in met.tolist() if c != cell])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int64()))], ["id", "label", "vector", "windows", "cells"])

        asked = anchors.select("id", "label", "vector", "windows").mapInArrow(ask, f"id long, label long, vector array<long>, windows {WINDOWS}, cells array<long>")
        dealt = asked.withColumn("cell", F.explode("cells")).join(self.parts, "cell")
        return dealt.withColumn("key", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("parts") - 1))).select("key", "id", "label", "vector", "windows")

    def _visited(self, asked: DataFrame, same: bool, k: int) -> DataFrame:
        """id, w, score and found: the first k rows of each window in each key. A key's rows come before its anchors, which stream."""
        dim, limit, sphere = self.dim, self.limit, self.sphere

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, tree, held, out = None, None, [], []

            def packed() -> pa.RecordBatch:
                columns = list(zip(*out, strict=True)) or [()] * 4
                out.clear()
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "w", "score", "found"])

            for batch in batches:
                keys, kinds = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                turns = np.flatnonzero((np.diff(keys) != 0) | (np.diff(kinds) != 0)) + 1
                for start, end in zip([0, *turns], [*turns, len(keys)], strict=True):
                    if start == end:
                        continue
                    part = batch.slice(start, end - start)
                    ids, labels = (part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                    vectors = matrix(part.column(4), dim, limit)
                    if keys[start] != at:
                        at, tree, held = keys[start], None, []
                    if not kinds[start]:
                        held.append((ids, labels, vectors))
                        continue
                    if tree is None and held:
                        tree, held = Tree(*map(np.concatenate, zip(*held, strict=True)), sphere), []
                    if tree is None:
                        continue
                    for anchor, label, vector, windows in zip(ids.tolist(), labels.tolist(), vectors, part.column(5).to_pylist(), strict=True):
                        asked = [(w["w"], w["low"], w["high"], w["least"]) for w in windows]
                        out += [(anchor, *row) for row in tree.search(vector, label, asked, same, k)]
                        if len(out) > HELD:
                            yield packed()
            yield packed()

        rows = self.placed.select("key", F.lit(0).alias("kind"), "id", "label", "vector", F.lit(None).cast(WINDOWS).alias("windows"))
        both = rows.unionByName(asked.withColumn("kind", F.lit(1)))
        return both.repartitionById(self.keys, F.col("key").cast("int")).sortWithinPartitions("key", "kind").mapInArrow(visit, "id long, w long, score long, found long")

    def search(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """id, w, score, found and rank of the first k rows, of the anchor's label or of others, in each of its windows.

        `anchors` has id (one for each row), label, vector and windows: w, low,
        high (scores) and least (a score that is already known to be among the first k).
        """
        first = cut(self._visited(self._asked(anchors, True), same, k))
        known = first.groupBy("id", "w").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(LEAST)).alias("least"))
        least = known.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("w", "least"))).alias("__least"))
        bounded = anchors.join(least, "id", "left").withColumn("windows", F.transform("windows", lambda x: x.withField("least", F.coalesce(F.col("__least")[x["w"]], F.lit(LEAST))))).drop("__least")
        others = self._visited(self._asked(bounded, False), same, k)
        order = Window.partitionBy("id", "w").orderBy(F.desc("score"), "found")
        return first.unionByName(others).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    `anchor` is a condition on the column id. An anchor's positives are the
    first rows of its label, itself left out; a positive's negatives the first
    rows of other labels with `low` to `high` hundredths of its score. Higher
    scores come first, ties by smaller id. Rows with a null label, a null
    vector or a component that is null or not finite take no part. A null id is
    no anchor and comes after all others. Repeated rows are rows of their own.
    Vectors of different lengths are filled with zeros; components are clipped
    where a score could leave a long (at 2^28 for 64 components). Other columns
    are never read; an empty table gives no rows.
    """
    points = usable(rows, id_col, vector_col, label_col, scale)
    index = Index(points, max(negatives, positives + 1), cell_rows)
    # One row an anchor, numbered, so that repeated ones stay apart.
    anchors = cut(index.clipped(points.where(anchor & (F.col("id") != MOST)).withColumnRenamed("id", "anchor_id").withColumn("id", F.monotonically_increasing_id())))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("w"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"), F.lit(LEAST).alias("least")))
    near = index.search(anchors.withColumn("windows", whole), True, positives + 1)
    # The anchor itself is left out once; if its copies stand before it, the last row found is.
    own = near.join(anchors.select("id", "anchor_id"), "id").withColumn("__own", F.min(F.when(F.col("found") == F.col("anchor_id"), F.col("rank"))).over(Window.partitionBy("id")))
    chosen = own.where(F.col("rank") != F.coalesce("__own", F.lit(positives + 1))).select("id", "anchor_id", F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    chosen = cut(chosen)
    wide = F.col("positive_score").cast("decimal(20,0)")
    window = F.struct(F.col("positive_score").alias("w"), F.ceil(wide * low / 100).cast("long").alias("low"), F.floor(wide * high / 100).cast("long").alias("high"), F.lit(LEAST).alias("least"))
    asked = chosen.where("positive_score >= 0").withColumn("window", window).where("window.low <= window.high").groupBy("id").agg(F.collect_set("window").alias("windows"))
    far = index.search(anchors.join(asked, "id"), False, negatives)
    met = chosen.join(far, (chosen["id"] == far["id"]) & (chosen["positive_score"] == far["w"]))
    named = lambda c: F.when(F.col(c) != MOST, F.col(c)).alias
    return met.select("anchor_id", named("positive_id")("positive_id"), "rank", named("found")("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), F.col("id") % 100 == 0)


SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 10
"""
