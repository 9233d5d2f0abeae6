"""An index of intervals that reads are held against inside their own task.

Annotation is small beside reads: a few ten thousand genes. So the genes become
sorted arrays that every task has, and reads never move: they are searched in
Arrow batches, and what a read's genes say of it is settled in its row.
Intervals are sorted by their start within classes of length, each up to twice
the shortest, so the starts that may reach a read are one short stretch of
every class, however long the longest gene is. Exons are looked up by the
number of exonic bases before a place, junctions in a sorted list.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Genes, and exons and junctions of all of them, that an index may have; it is sent to every task.
MAX_GENES, MAX_PARTS = 500_000, 20_000_000
#: A place on chromosome number c counts as c * SPAN + place.
SPAN = 1 << 40
VOTES = ["none", "unspliced", "ambiguous", "spliced"]


@lru_cache(1 << 16)
def cigar_blocks(cigar: str) -> tuple[tuple[int, int], ...]:
    """Matched blocks, both ends inclusive, of a read that starts at 0; N ends a block, I, S, H and P count for nothing."""
    found, at, start, n = [], 0, 0, 0
    for c in cigar or "":
        if c.isdigit():
            n = 10 * n + ord(c) - 48
            continue
        if c in "M=XD":
            at += n
        elif c == "N":
            found.append((start, at - 1))
            at += n
            start = at
        n = 0
    found.append((start, at - 1))
    return tuple((a, b) for a, b in found if b >= a)


def stretches(first: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each range [first, past): the range's number and each of its members."""
    n = np.maximum(past - first, 0)
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]


class GeneIndex:
    """Sorted arrays of genes: chrom, lft, rgt and, to classify reads, gene_strand, exons and junctions."""

    def __init__(self, genes: pa.Table):
        self.genes = genes
        self.codes = {name: i for i, name in enumerate(pc.unique(genes["chrom"]).to_pylist()) if name is not None}
        chrom, self.lft, self.rgt = self.coded(genes["chrom"]), self.longs(genes["lft"]), self.longs(genes["rgt"])
        length = self.rgt - self.lft
        kind = np.frexp(np.maximum(length, 1).astype(float))[1]
        self.classes = []
        for k in np.unique(kind[chrom >= 0]):
            own = np.flatnonzero((kind == k) & (chrom >= 0))
            key = chrom[own] * SPAN + self.lft[own]
            order = np.argsort(key, kind="stable")
            self.classes.append((int(length[own].max()), key[order], own[order]))
        if "exons" in genes.column_names:
            self.strand = np.asarray([s == "+" for s in genes["gene_strand"].to_pylist()])
            self.exons = self._exons(genes["exons"])
            self.junctions = self._junctions(genes["junctions"])

    @staticmethod
    def longs(column) -> np.ndarray:
        return np.asarray(column.to_numpy(), np.int64)

    def coded(self, column) -> np.ndarray:
        """Numbers of chromosomes; -1 for those without genes and null."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        found = column.dictionary_encode()
        codes = np.asarray([self.codes.get(c, -1) for c in found.dictionary.to_pylist()] + [-1], np.int64)
        return codes[pc.fill_null(found.indices, len(codes) - 1).to_numpy(zero_copy_only=False)]

    def _parts(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the gene, lft and rgt of all members of a list column, sorted."""
        column = column.combine_chunks()
        gene, flat = np.asarray(pc.list_parent_indices(column)), column.flatten()
        lft, rgt = (self.longs(flat.field(i)) for i in (0, 1))
        order = np.lexsort((rgt, lft, gene))
        return gene[order].astype(np.int64), lft[order], rgt[order]

    def _exons(self, column):
        gene, lft, rgt = self._parts(column)
        size = rgt - lft + 1
        return gene * SPAN + lft, lft, size, np.cumsum(size) - size, np.searchsorted(gene, np.arange(len(self.lft)))

    def _junctions(self, column):
        gene, lft, rgt = self._parts(column)
        starts, ends = np.unique(gene * SPAN + lft), np.unique(rgt)
        return starts, ends, np.unique(np.searchsorted(starts, gene * SPAN + lft) * max(len(ends), 1) + np.searchsorted(ends, rgt))

    def overlapping(self, chrom: np.ndarray, lft: np.ndarray, rgt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of reads and genes of all pairs with gene.lft < rgt and lft < gene.rgt."""
        rows = np.flatnonzero(chrom >= 0)
        base, a, b = chrom[rows] * SPAN, lft[rows], rgt[rows]
        reads, genes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for longest, keys, own in self.classes:
            of, at = stretches(np.searchsorted(keys, base + np.maximum(a - longest, 0)), np.searchsorted(keys, base + np.maximum(b, 0)))
            hit = self.rgt[own[at]] > a[of]
            reads.append(rows[of[hit]])
            genes.append(own[at[hit]])
        return np.concatenate(reads), np.concatenate(genes)

    def exonic_before(self, gene: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Bases of the gene's exons before a place."""
        key, lft, size, before, first = self.exons
        at = np.searchsorted(key, gene * SPAN + place, "right") - 1
        inside = at >= first[gene]
        at = np.where(inside, at, 0)
        if not len(key):
            return np.zeros(len(gene), np.int64)
        return np.where(inside, before[at] + np.minimum(place - lft[at], size[at]) - before[np.minimum(first[gene], len(before) - 1)], 0)

    def known(self, gene: np.ndarray, lft: np.ndarray, rgt: np.ndarray) -> np.ndarray:
        """Whether a gap is one of the gene's junctions."""
        starts, ends, pairs = self.junctions
        if not len(pairs):
            return np.zeros(len(gene), bool)
        start, end = gene * SPAN + lft, rgt
        i, j = np.minimum(np.searchsorted(starts, start), len(starts) - 1), np.minimum(np.searchsorted(ends, end), len(ends) - 1)
        pair = i * len(ends) + j
        return (starts[i] == start) & (ends[j] == end) & (pairs[np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)] == pair)

    def classify(self, chrom, pos, cigar, strand, least_bases: int, least_share: float, least_intronic: int, least_exonic: float, known_only: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each read the number of its gene (-1: none), its vote (a place in VOTES) and how many genes hold it."""
        n = len(pos)
        found = cigar.dictionary_encode()
        shapes = [cigar_blocks(c) for c in found.dictionary.to_pylist()] + [()]
        shape = pc.fill_null(found.indices, len(shapes) - 1).to_numpy(zero_copy_only=False)
        counts = np.asarray([len(s) for s in shapes])
        flat = np.asarray([b for s in shapes for b in s], np.int64).reshape(-1, 2)
        begins = np.cumsum(counts) - counts
        n_blocks = counts[shape]
        first = np.cumsum(n_blocks) - n_blocks
        of, at = stretches(begins[shape], begins[shape] + n_blocks)
        left, right = flat[at, 0] + pos[of], flat[at, 1] + pos[of]
        bases = np.bincount(of, right - left + 1, n).astype(np.int64)
        some = n_blocks > 0
        lft, rgt = np.zeros(n, np.int64), np.zeros(n, np.int64)
        lft[some], rgt[some] = left[first[some]], right[first[some] + n_blocks[some] - 1]
        read, gene = self.overlapping(np.where(some, self.coded(chrom), -1), lft, rgt)
        forward = np.asarray([s == "+" for s in strand.to_pylist()], bool)
        own = forward[read] == self.strand[gene]
        read, gene = read[own], gene[own]
        pair, block = stretches(first[read], first[read] + n_blocks[read])
        g = gene[pair]
        inside = np.maximum(np.minimum(right[block], self.rgt[g]) - np.maximum(left[block], self.lft[g]) + 1, 0)
        total = lambda x: np.bincount(pair, x, len(read)).astype(np.int64)
        gene_bases = total(inside)
        held = (total(inside > 0) == n_blocks[read]) & (gene_bases >= least_bases) & (gene_bases / np.maximum(bases[read], 1) >= least_share)
        exonic = total(self.exonic_before(g, right[block] + 1) - self.exonic_before(g, left[block]))
        last = block + 1 < first[read][pair] + n_blocks[read][pair]
        known = np.bincount(pair[last], self.known(g[last], right[block[last]], left[block[last] + 1]), len(read)).astype(np.int64)
        if known_only:
            held &= known == n_blocks[read] - 1
        vote = np.where((gene_bases - exonic >= least_intronic) & (n_blocks[read] == 1), 1, np.where(exonic / np.maximum(gene_bases, 1) >= least_exonic, np.where(known > 0, 3, 2), 0))
        read, gene, vote = read[held], gene[held], vote[held]
        is_exonic, is_intronic = vote >= 2, vote == 1
        by_exons, by_introns = np.bincount(read[is_exonic], minlength=n), np.bincount(read[is_intronic], minlength=n)
        chosen, kind = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        for mine, sure in ((is_exonic, by_exons == 1), (is_intronic, (by_exons == 0) & (by_introns == 1))):
            use = mine & sure[read]
            chosen[read[use]], kind[read[use]] = gene[use], vote[use]
        return chosen, kind, np.bincount(read, minlength=n)


def index_of(genes: DataFrame, max_genes: int = MAX_GENES, max_parts: int = MAX_PARTS) -> GeneIndex | None:
    """The index, or None if the genes are more than a task may hold."""
    parts = F.sum(F.size("exons") + F.size("junctions")) if "exons" in genes.columns else F.lit(0)
    count, parts = genes.limit(max_genes + 1).agg(F.count(F.lit(1)), parts).first()
    if count > max_genes or (parts or 0) > max_parts:
        return None
    return GeneIndex(genes.toArrow())


def fields_of(df: DataFrame, **renamed: str) -> list[T.StructField]:
    return [T.StructField(renamed.get(f.name, f.name), f.dataType) for f in df.schema.fields]


def overlapping_pairs(reads: DataFrame, genes: DataFrame, index: GeneIndex) -> DataFrame:
    """Rows of reads (chrom, lft, rgt and others) with those of genes that they overlap; the genes' lft and rgt become gene_lft and gene_rgt. Reads stay in their partitions."""
    renamed = {"lft": "gene_lft", "rgt": "gene_rgt"}
    schema = T.StructType([*fields_of(reads), *[f for f in fields_of(genes, **renamed) if f.name != "chrom"]])
    sent = reads.sparkSession.sparkContext.broadcast(index)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        table = index.genes.drop_columns(["chrom"])
        for batch in batches:
            at = {name: batch.column(batch.schema.get_field_index(name)) for name in ("chrom", "lft", "rgt")}
            placed = at["lft"].is_valid().to_numpy(zero_copy_only=False) & at["rgt"].is_valid().to_numpy(zero_copy_only=False)
            lft, rgt = (pc.fill_null(at[c], 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lft", "rgt"))
            read, gene = index.overlapping(np.where(placed, index.coded(at["chrom"]), -1), lft, rgt)
            for start in range(0, len(read), 10_000):
                mine, theirs = batch.take(pa.array(read[start : start + 10_000])), table.take(pa.array(gene[start : start + 10_000])).combine_chunks()
                columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in theirs.columns]
                yield pa.RecordBatch.from_arrays([*mine.columns, *columns], schema.names)

    return reads.mapInArrow(pairs, schema)


def classified(reads: DataFrame, genes: DataFrame, index: GeneIndex, least_bases: int = 40, least_share: float = 0.95, least_intronic: int = 15, least_exonic: float = 0.95, known_only: bool = False) -> DataFrame:
    """`reads` (chrom, pos, cigar, strand and others) with gene, class and held_by (how many genes hold the read) added; rows and partitions stay as they are."""
    kind = genes.schema["gene"].dataType
    schema = T.StructType([*fields_of(reads), T.StructField("gene", kind), T.StructField("class", T.StringType()), T.StructField("held_by", T.LongType())])
    sent = reads.sparkSession.sparkContext.broadcast(index)
    options = (least_bases, least_share, least_intronic, least_exonic, known_only)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        names = index.genes["gene"].combine_chunks()
        words = np.asarray(["no_gene", *VOTES[1:]], object)
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            pos = pc.fill_null(column("pos"), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            chosen, vote, held = index.classify(column("chrom"), pos, column("cigar"), column("strand"), *options)
            gene = names.take(pa.array(np.where(chosen < 0, 0, chosen), mask=chosen < 0)) if len(names) else pa.nulls(len(chosen), names.type)
            yield pa.RecordBatch.from_arrays([*batch.columns, gene, pa.array(words[vote], pa.string()), pa.array(held, pa.int64())], schema.names)

    return reads.mapInArrow(judge, schema)
