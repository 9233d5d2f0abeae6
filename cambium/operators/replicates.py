"""Replicates of a count matrix held against each other: variable genes, neighbours and communities."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept
from . import communities, neighbours, stability


@dataclass
class Replicates:
    """What each replicate has come to, in tables with a column `seed`."""

    #: seed, gene, score
    genes: DataFrame
    #: seed, id, other, place
    near: DataFrame
    #: seed, resolution, id, community
    groups: DataFrame

    def _pairs(self, of: DataFrame, keys: list[str]) -> DataFrame:
        """Rows of every two seeds, smaller first, that agree in keys: a, b, keys and the columns of either side as x and y."""
        other = [c for c in of.columns if c not in ("seed", *keys)]
        left = of.select(F.col("seed").alias("a"), *keys, *[F.col(c).alias(f"x_{c}") for c in other])
        right = of.select(F.col("seed").alias("b"), *keys, *[F.col(c).alias(f"y_{c}") for c in other])
        return left.join(right, keys).where("a < b")

    def rand(self) -> DataFrame:
        """a, b, resolution, ari: of the barcodes that both replicates have."""
        return stability.adjusted_rand_by(self._pairs(self.groups, ["resolution", "id"]), ["a", "b", "resolution"], "x_community", "y_community")

    def clusters(self) -> DataFrame:
        """seed, resolution and the number of communities."""
        return self.groups.groupBy("seed", "resolution").agg(F.countDistinct("community").alias("clusters"))

    def gene_overlap(self) -> DataFrame:
        """a, b, jaccard of the variable genes; two empty sets agree."""
        spark = self.genes.sparkSession
        sizes = {r["seed"]: r["n"] for r in self.genes.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a replicate
        seeds = sorted({r["seed"] for r in self.groups.select("seed").distinct().collect()} | set(sizes))
        shared = {(r["a"], r["b"]): r["n"] for r in self._pairs(self.genes.select("seed", "gene"), ["gene"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).collect()}
        rows = [(a, b, shared.get((a, b), 0), sizes.get(a, 0) + sizes.get(b, 0)) for a, b in combinations(seeds, 2)]
        return spark.createDataFrame([(a, b, n / (whole - n) if whole else 1.0) for a, b, n, whole in rows], "a long, b long, jaccard double")

    def neighbour_overlap(self) -> DataFrame:
        """a, b and the mean and median Jaccard index of the barcodes' neighbours."""
        shared = self._pairs(self.near.select("seed", "id", "other"), ["id", "other"]).groupBy("a", "b", "id").agg(F.count(F.lit(1)).alias("shared"))
        sizes = self.near.groupBy("seed", "id").agg(F.count(F.lit(1)).alias("n"))
        both = self._pairs(sizes, ["id"]).join(shared, ["a", "b", "id"], "left").fillna(0, ["shared"])
        index = F.col("shared") / (F.col("x_n") + F.col("y_n") - F.col("shared"))
        return both.groupBy("a", "b").agg(F.avg(index).alias("mean"), F.median(index).alias("median"))


def replicates(tables: dict[int, DataFrame], resolutions: Sequence[float] = (1.0,), top_genes: int = 2000, components: int = 30, k: int = 30, min_cells: int = 10, recall: float = 0.95) -> Replicates:
    """Replicates of counts (barcode, gene, value) by seed.

    Each goes through variable genes, scaled scores, principal components and
    near neighbours by itself; the communities of all of them, at all
    resolutions, are found in the same jobs.
    """
    genes, near = [], []
    for seed, counts in tables.items():
        counts = kept(counts.where("value > 0"))
        cells = counts.select("barcode").distinct().count()
        often = counts.groupBy("gene").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_cells).select("gene")
        counts = kept(counts.join(often, "gene", "left_semi"))
        top = kept(stability.variable_genes(counts, cells, top_genes))
        chosen = sorted(r["gene"] for r in top.select("gene").collect())  # top_genes at most
        genes.append(top.select(F.lit(seed).cast("long").alias("seed"), "gene", "score"))
        scores = stability.scaled(stability.log_normalised(counts).join(F.broadcast(top.select("gene")), "gene"), cells)
        vectors = stability.dense_vectors(scores, chosen)
        pcs = stability.principal_components(vectors, max(1, min(components, len(chosen)))).select("id", F.col("pcs").alias("vec"))
        near.append(kept(neighbours.near_neighbours(pcs, k, recall)).select(F.lit(seed).cast("long").alias("seed"), "id", "other", "place"))
    joined = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(joined(parts[1:]))
    links = joined(near)
    edges = links.groupBy("seed", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return Replicates(joined(genes), links, kept(communities.communities_at(kept(edges), resolutions, "seed")))
