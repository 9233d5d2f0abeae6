"""Reads against gene annotation: CIGAR blocks, a range join, and classes of reads."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import kept
from . import intervals

BIN = 1024
#: Parts that the reads of a crowded bin are dealt to where genes are too many for an index; reads from which a bin is crowded; crowded bins that are broadcast, at most.
SALTS, CROWDED, MAX_CROWDED = 16, 100_000, 100_000
BLOCKS = T.ArrayType(T.StructType([T.StructField("lft", T.LongType()), T.StructField("rgt", T.LongType())]))


@F.arrow_udf(BLOCKS)
def blocks_of(pos: pa.Array, cigar: pa.Array) -> pa.Array:
    """First base (0-based) and CIGAR string to blocks of matched bases, both ends inclusive; N ends a block, I, S, H and P count for nothing. Each different string is read once a batch."""
    found = cigar.dictionary_encode()
    shapes = [intervals.cigar_blocks(c) for c in found.dictionary.to_pylist()] + [()]
    counts = np.asarray([len(x) for x in shapes])
    flat = np.asarray([x for shape in shapes for x in shape], np.int64).reshape(-1, 2)
    shape = np.where(pos.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(found.indices, len(shapes) - 1).to_numpy(zero_copy_only=False), len(shapes) - 1)
    first = (np.cumsum(counts) - counts)[shape]
    of, at = intervals.stretches(first, first + counts[shape])
    base = pc.fill_null(pos, 0).to_numpy(zero_copy_only=False).astype(np.int64)[of]
    blocks = pa.StructArray.from_arrays([pa.array(flat[at, 0] + base), pa.array(flat[at, 1] + base)], ["lft", "rgt"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts[shape])), pa.int32()), blocks, mask=cigar.is_null())


def with_blocks(reads: DataFrame) -> DataFrame:
    """Adds blocks, and lft and rgt of the whole read."""
    return reads.withColumn("blocks", blocks_of(F.col("pos").cast("long"), "cigar")).withColumn("lft", F.get("blocks", F.lit(0))["lft"]).withColumn("rgt", F.try_element_at("blocks", F.lit(-1))["rgt"])


def range_join(reads: DataFrame, genes: DataFrame, max_genes: int = intervals.MAX_GENES) -> DataFrame:
    """Pairs on a chromosome whose closed spans overlap by more than their ends (gene.lft < rgt and lft < gene.rgt).

    Up to `max_genes` genes are an index in every task, and reads don't move;
    more are joined by genome bins. Rows without a chromosome or an end have no pairs.
    """
    index = intervals.index_of(genes, max_genes)
    return binned_join(reads, genes) if index is None else intervals.overlapping_pairs(reads, genes, index)


def binned_join(reads: DataFrame, genes: DataFrame, width: int = BIN, salts: int = SALTS, crowded: int = CROWDED) -> DataFrame:
    """range_join of genes of any number.

    Both sides go to all bins that they touch and meet by an equi-join; a pair
    counts only in the first bin that both touch, so no distinct is needed. The
    reads of a bin with more than `crowded` are dealt to `salts` parts, each of
    which has its genes, so a gene that most reads come from is not one task's;
    other bins have one part. Neither side is broadcast: what rows become in
    bins isn't seen in the size that the planner takes a table to have.
    """

    def binned(df: DataFrame, name: str, lft: str, rgt: str) -> DataFrame:
        return df.withColumn(name, F.floor(F.col(lft) / width)).withColumn("bin", F.explode(F.sequence(F.floor(F.col(lft) / width), F.floor(F.col(rgt) / width))))

    reads = kept(reads)  # looked at twice, and what their columns are made by isn't made again for each place that names them
    left, right = binned(reads, "__first", "lft", "rgt"), binned(genes.withColumnsRenamed({"lft": "gene_lft", "rgt": "gene_rgt"}), "__gene_first", "gene_lft", "gene_rgt")
    full = kept(left.groupBy("chrom", "bin").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > crowded).select("chrom", "bin", F.lit(salts).alias("__parts")))
    if full.limit(MAX_CROWDED + 1).count() <= MAX_CROWDED:
        full = F.broadcast(full)
    parts = F.coalesce("__parts", F.lit(1))
    left = left.join(full, ["chrom", "bin"], "left").withColumn("__salt", F.pmod(F.xxhash64(*reads.columns), parts).cast("int")).drop("__parts")
    right = right.join(full, ["chrom", "bin"], "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    met = left.hint("merge").join(right, ["chrom", "bin", "__salt"]).where("gene_lft < rgt AND lft < gene_rgt AND bin = greatest(__first, __gene_first)")
    return met.drop("bin", "__first", "__gene_first", "__salt")


def classified(reads: DataFrame, genes: DataFrame, read_id: str, known_only: bool = False, max_genes: int = intervals.MAX_GENES) -> DataFrame:
    """`reads` (chrom, pos, cigar, strand, a unique id and others) with gene (null: none), class and held_by, the number of genes that hold the read.

    With an index every read is settled in its row; without, reads meet genes
    by bins, and votes are joined back by `read_id`.
    """
    index = intervals.index_of(genes, max_genes)
    if index is not None:
        return intervals.classified(reads, genes, index, known_only=known_only)
    placed = with_blocks(reads.select(F.col(read_id).alias("read_id"), "chrom", "pos", "cigar", "strand")).where("lft is not null")
    found = resolve(votes(binned_join(placed, genes), known_only=known_only))
    joined = reads.join(found.withColumnRenamed("read_id", read_id), read_id, "left").select(*reads.columns, "gene", "class", "held_by")
    return joined.withColumn("class", F.coalesce("class", F.lit("no_gene"))).fillna(0, ["held_by"])


def junctions(exons: DataFrame) -> DataFrame:
    """Gaps between a transcript's consecutive exons, as the ends that they join."""
    before = Window.partitionBy("transcript").orderBy("lft", "rgt")
    return exons.select("transcript", F.lag("rgt").over(before).alias("lft"), F.col("lft").alias("rgt")).where("lft is not null")


def merged_exons(exons: DataFrame) -> DataFrame:
    """Each gene's exons with those that overlap, closed ends, joined."""
    order = Window.partitionBy("gene").orderBy("lft", "rgt")
    past = F.max("rgt").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = exons.withColumn("fresh", F.coalesce((F.col("lft") > past).cast("int"), F.lit(1)))
    return fresh.withColumn("island", F.sum("fresh").over(order)).groupBy("gene", "island").agg(F.min("lft").alias("lft"), F.max("rgt").alias("rgt")).drop("island")


def gene_breaks(genes: DataFrame, delta: int) -> DataFrame:
    """Places in gaps of more than `delta` between the genes of a chromosome."""
    order = Window.partitionBy("chrom").orderBy("lft", "rgt")
    past = genes.withColumn("past", F.max("rgt").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return past.where(F.col("lft") - F.col("past") > delta).select("chrom", (F.col("past") + delta // 2).alias("at"))


def votes(hits: DataFrame, least_bases: int = 40, least_share: float = 0.95, least_intronic: int = 15, least_exonic: float = 0.95, known_only: bool = False) -> DataFrame:
    """For each pair of read (blocks) and gene (exons) that pass containment on the gene's strand, its vote: unspliced, spliced, ambiguous or none.

    With `known_only`, a read with a gap that isn't one of the gene's junctions has no vote for it.
    """
    found = (
        hits.withColumn("bases", F.expr("aggregate(blocks, 0L, (n, b) -> n + b.rgt - b.lft + 1)"))
        .withColumn("inside", F.expr("transform(blocks, b -> greatest(0L, least(b.rgt, gene_rgt) - greatest(b.lft, gene_lft) + 1))"))
        .withColumn("gene_bases", F.expr("aggregate(inside, 0L, (n, x) -> n + x)"))
        .where(F.expr("forall(inside, x -> x > 0)") & (F.col("gene_bases") >= least_bases) & (F.col("gene_bases") / F.col("bases") >= least_share) & (F.col("strand") == F.col("gene_strand")))
        .withColumn("exonic", F.expr("aggregate(blocks, 0L, (n, b) -> n + aggregate(exons, 0L, (m, e) -> m + greatest(0L, least(b.rgt, e.rgt) - greatest(b.lft, e.lft) + 1)))"))
        .withColumn("gaps", F.expr("CASE WHEN size(blocks) > 1 THEN transform(sequence(1, size(blocks) - 1), i -> named_struct('lft', blocks[i - 1].rgt, 'rgt', blocks[i].lft)) ELSE cast(array() as array<struct<lft:bigint,rgt:bigint>>) END"))
        .withColumn("known", F.expr("size(array_intersect(gaps, junctions))"))
        .withColumn(
            "vote",
            F.when((F.col("gene_bases") - F.col("exonic") >= least_intronic) & (F.size("blocks") == 1), "unspliced")
            .when(F.col("exonic") / F.col("gene_bases") >= least_exonic, F.when(F.col("known") > 0, "spliced").otherwise("ambiguous"))
            .otherwise("none"),
        )
    )
    return found.where("known = size(gaps)") if known_only else found


def resolve(voted: DataFrame) -> DataFrame:
    """Each read's gene and class: of a single spliced or ambiguous gene, else, if there is none such, of a single unspliced one."""
    exonic = F.col("vote").isin("spliced", "ambiguous")
    counted = voted.groupBy("read_id").agg(
        F.count(F.lit(1)).alias("held_by"), F.count_if(exonic).alias("exonic"), F.count_if(F.col("vote") == "unspliced").alias("intronic"),
        F.max(F.when(exonic, F.struct("gene", "vote"))).alias("e"), F.max(F.when(F.col("vote") == "unspliced", F.struct("gene", "vote"))).alias("i"),
    )
    chosen = F.when(F.col("exonic") == 1, F.col("e")).when((F.col("exonic") == 0) & (F.col("intronic") == 1), F.col("i"))
    return counted.select("read_id", chosen["gene"].alias("gene"), F.coalesce(chosen["vote"], F.lit("no_gene")).alias("class"), "held_by")
