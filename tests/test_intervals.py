"""The index of genes against brute force and against the join by bins."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cambium.operators import annotate, intervals

GENE = "gene long, chrom string, lft long, rgt long, gene_strand string, exons array<struct<lft:long,rgt:long>>, junctions array<struct<lft:long,rgt:long>>"


def made_genes(rng, n):
    rows = []
    for i in range(n):
        at, exons = rng.randrange(3000), []
        for _ in range(rng.randrange(1, 5)):
            size = rng.randrange(5, 150)
            exons.append((at, at + size))
            at += size + rng.randrange(20, 120)
        lft, rgt = exons[0][0], exons[-1][1]
        gaps = [(a[1], b[0]) for a, b in zip(exons, exons[1:])]
        if i == 0:
            lft, rgt = 0, 100_000  # one gene over the whole chromosome
        rows.append((i, rng.choice(["c1", "c2"]), lft, rgt, rng.choice("+-"), exons, gaps))
    return rows


def made_reads(rng, genes, n):
    rows = []
    for i in range(n):
        gene = rng.choice(genes)
        if rng.random() < 0.5 and gene[6]:
            a, b = rng.choice(gene[6])
            left, right = rng.randrange(1, 60), rng.randrange(1, 60)
            pos, cigar = a - left + 1, f"{left}M{b - a - 1}N{right}M"
        else:
            pos = rng.randrange(max(gene[2] - 50, 0), gene[2] + 400)
            cigar = rng.choice(["60M", "3S50M2I5M1D4M", "30M40N30M", "45M", "20M10N20M10N20M", "5S", "*", "100M3H"])
        rows.append((i, rng.choice([gene[1], gene[1], "c1", "c3", None]), max(pos, 0), cigar if rng.random() < 0.97 else None, rng.choice([gene[4], "+", "-"])))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(11)
    genes = made_genes(rng, 60)
    reads = made_reads(rng, genes, 3000)
    return spark.createDataFrame(genes, GENE), spark.createDataFrame(reads, "id long, chrom string, pos long, cigar string, strand string").repartition(3).cache(), genes, reads


def test_pairs(spark, tables):
    genes, reads, gene_rows, _ = tables
    placed = annotate.with_blocks(reads)
    want = {(r["id"], g[0]) for r in placed.collect() if r["chrom"] and r["lft"] is not None for g in gene_rows if g[1] == r["chrom"] and g[2] < r["rgt"] and r["lft"] < g[3]}
    by_index, by_bins = annotate.range_join(placed, genes), annotate.range_join(placed, genes, max_genes=0)
    assert sorted(by_index.columns) == sorted(by_bins.columns)
    for found in (by_index, by_bins):
        rows = found.select("id", "gene").collect()
        assert len(rows) == len(want) and set(map(tuple, rows)) == want
    assert by_index.where("gene_lft >= rgt").count() == 0


@pytest.mark.parametrize("crowded", [0, 20, 10**9])
def test_bins_are_not_broadcast(spark, tables, crowded):
    """However small the planner takes the genes to be: bins and parts make many rows of each."""
    genes, reads, *_ = tables
    placed = annotate.with_blocks(reads)
    found = annotate.binned_join(placed, genes, crowded=crowded)
    joins = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [chrom" in joins and "__salt" not in "".join(line for line in joins.splitlines() if "BroadcastHashJoin" in line)
    want = {(r["id"], r["gene"]) for r in annotate.range_join(placed, genes).collect()}
    rows = [tuple(r) for r in found.select("id", "gene").collect()]
    assert len(rows) == len(want) and set(rows) == want


@pytest.mark.parametrize("known_only", [False, True])
def test_classes(tables, known_only):
    genes, reads, *_ = tables
    columns = ["id", "gene", "class", "held_by"]
    by_index = sorted(map(tuple, annotate.classified(reads, genes, "id", known_only).select(columns).collect()))
    by_bins = sorted(map(tuple, annotate.classified(reads, genes, "id", known_only, max_genes=0).select(columns).collect()))
    assert by_index == by_bins and len(by_index) == 3000
    assert {c for _, _, c, _ in by_index} == {"spliced", "ambiguous", "unspliced", "no_gene"}


def test_reads_do_not_move(tables):
    genes, reads, *_ = tables
    for found in (annotate.classified(reads, genes, "id"), annotate.range_join(annotate.with_blocks(reads), genes)):
        above = found._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
        assert "Exchange" not in above and "Join" not in above


def test_bounds_and_empty_genes(spark, tables):
    genes, reads, *_ = tables
    assert intervals.index_of(genes, 59) is None and intervals.index_of(genes, 60, 10) is None and intervals.index_of(genes, 60) is not None
    none = genes.where("false")
    assert annotate.range_join(annotate.with_blocks(reads), none).count() == 0
    assert {tuple(r) for r in annotate.classified(reads, none, "id").select("gene", "class", "held_by").distinct().collect()} == {(None, "no_gene", 0)}
    assert annotate.classified(reads.where("false"), genes, "id").count() == 0


def test_a_stretch_is_short(tables):
    """The long gene doesn't widen what is looked at for the others."""
    rng = np.random.default_rng(0)
    lft = np.sort(rng.integers(0, 10**7, 5000))
    genes = pa.table({"gene": np.arange(5001), "chrom": ["c"] * 5001, "lft": np.append(lft, 0), "rgt": np.append(lft + rng.integers(100, 3000, 5000), 10**7)})
    index = intervals.GeneIndex(genes)
    at = rng.integers(0, 10**7, 200)
    looked = sum(int((np.searchsorted(keys, at + 50) - np.searchsorted(keys, np.maximum(at - longest, 0))).sum()) for longest, keys, _ in index.classes)
    read, _ = index.overlapping(np.zeros(200, np.int64), at, at + 50)
    assert len(read) >= 200 and looked < 3 * len(read) + 200


def test_cigars():
    assert intervals.cigar_blocks("10M5N10M") == ((0, 9), (15, 24)) and intervals.cigar_blocks("3S4M1D2I5=2X3H") == ((0, 11),)
    assert intervals.cigar_blocks("*") == intervals.cigar_blocks("7S") == () and intervals.cigar_blocks("5N7M") == ((5, 11),)
