"""From alignments to a molecule table, and what samples of one hold."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import annotate, classify, matrices, molecules, numbering, summaries, thinning
from .session import kept
from .sources.libraries import FIELDS


def genes_of(annotation: DataFrame) -> DataFrame:
    """gene (a number from 0, by place), gene_id, gene_name, chrom, gene_strand, lft, rgt, exons and junctions, from read_gtf."""
    own = annotation.where("feature = 'gene'").select("gene_id", "gene_name", "chrom", F.col("strand").alias("gene_strand"), "lft", "rgt")
    parts = annotation.where("feature = 'exon'").select(F.col("gene_id").alias("gene"), F.col("transcript_id").alias("transcript"), "lft", "rgt")
    blocks = annotate.merged_exons(parts.select("gene", "lft", "rgt").distinct()).groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("lft", "rgt"))).alias("exons"))
    named = parts.select("gene", "transcript").distinct()
    gaps = annotate.junctions(parts.select("transcript", "lft", "rgt").distinct()).join(named, "transcript").groupBy("gene").agg(F.collect_set(F.struct("lft", "rgt")).alias("junctions"))
    kind = "array<struct<lft:bigint,rgt:bigint>>"
    full = own.join(blocks.withColumnRenamed("gene", "gene_id"), "gene_id", "left").join(gaps.withColumnRenamed("gene", "gene_id"), "gene_id", "left")
    empty = F.array().cast(kind)
    whole = full.withColumns({"exons": F.coalesce(F.col("exons").cast(kind), empty), "junctions": F.coalesce(F.col("junctions").cast(kind), empty)})
    return numbering.numbered(whole, ["chrom", "lft", "rgt", "gene_id"], "gene")


def statuses(reads: DataFrame, library: tuple, least_quality: int = 255) -> DataFrame:
    """Reads of read_sam or read_bam with random_hex and status, the first test that fails deciding."""
    spec = dict(zip(FIELDS, library))
    length, pattern = spec["UR_length"], spec["CB_re"].removeprefix("^").removesuffix("$")
    found = classify.read_status(reads, length, pattern, least_quality)
    if spec["CB_length"]:
        found = found.withColumn("status", F.when(F.coalesce(F.length("cb") != spec["CB_length"], F.lit(True)), "bad_tags").otherwise(F.col("status")))
    if not spec["random_hex_re"]:
        return found.withColumn("random_hex", F.lit(False))
    primer = F.regexp_extract("qname", spec["random_hex_re"], 1)
    return found.withColumn("random_hex", primer == spec["random_hex_value"]).withColumn("status", F.when(primer == "", "bad_tags").otherwise(F.col("status")))


def of_samples(judged: DataFrame, samples: list[str], tag: str = "sample") -> DataFrame:
    """Judged reads of the listed samples, with the sample before the barcode; those of others, or of none, have bad tags."""
    listed = F.coalesce(F.col(tag).isin(samples), F.lit(False))
    named = judged.withColumn("status", F.when(listed, F.col("status")).otherwise("bad_tags"))
    return named.withColumn("cb", F.when(listed, F.concat(F.col(tag), F.lit("_"), F.col("cb"))).otherwise(F.col("cb")))


def raw_reads(reads: DataFrame, genes: DataFrame, library: tuple, least_quality: int = 255, known_only: bool = False, samples: list[str] | None = None) -> DataFrame:
    """Every read with its status (no_gene among them) and, if countable, its gene and class.

    Probe-based libraries take the gene that the read names, and call it ambiguous;
    others are held against the annotation by a range join. With `samples`, reads
    have a column `sample` and only those of listed samples count.
    """
    spec = dict(zip(FIELDS, library))
    judged = statuses(reads, library, least_quality)
    if samples is not None:
        judged = of_samples(judged, samples)
    if spec["probe_based"]:
        known = judged.join(genes.select("gene", F.col("gene_id").alias("gx")), "gx", "left")
        return known.withColumn("status", F.when((F.col("status") == "countable") & F.col("gene").isNull(), "no_gene").otherwise(F.col("status"))).withColumn("class", F.when(F.col("status") == "countable", "ambiguous"))
    backward = F.col("flag").bitwiseAND(F.lit(16)) != 0
    strand = F.when(backward == F.lit(bool(spec["five_prime_like"])), "+").otherwise("-")
    # The number of a read must not change when a task is run again, so it's taken from a written table.
    numbered = kept(judged.withColumn("read_id", F.monotonically_increasing_id()))
    countable = F.col("status") == "countable"
    asked = numbered.withColumns({"strand": strand, "chrom": F.when(countable, F.col("chrom"))})
    joined = annotate.classified(asked, genes, "read_id", known_only).drop("read_id", "strand", "held_by").withColumn("class", F.when(F.col("gene").isNotNull(), F.col("class")))
    return joined.withColumn("status", F.when((F.col("status") == "countable") & F.col("gene").isNull(), "no_gene").otherwise(F.col("status")))


def molecule_tags(reads: DataFrame, top: int = 65535) -> DataFrame:
    """The molecule table: reads of each class for each barcode, gene, tag and primer, at most `top` each."""
    return reads.where("status = 'countable'").groupBy("cb", "gene", F.col("umi_code").alias("umi"), "random_hex").agg(*[F.least(F.count_if(F.col("class") == c), F.lit(top)).alias(c) for c in thinning.CLASSES])


def barcode_index(reads: DataFrame, tags: DataFrame) -> DataFrame:
    """Every barcode that a well-formed read bears, with its number (from 0, by sequence), reads, countable reads by primer, and raw molecules."""
    countable = F.col("status") == "countable"
    totals = reads.where("status <> 'bad_tags'").groupBy("cb").agg(
        F.count(F.lit(1)).alias("total_reads"), F.count_if(countable).alias("countable_reads"),
        F.count_if(countable & F.col("random_hex")).alias("countable_random_hex"), F.count_if(countable & ~F.col("random_hex")).alias("countable_poly_A"),
    )
    index = totals.join(tags.groupBy("cb").agg(F.count(F.lit(1)).alias("raw_molecules")), "cb", "left").fillna(0, ["raw_molecules"])
    return numbering.numbered(index, ["cb"], "barcode")


@dataclass
class Sample:
    """Molecules of every seed and fraction; each method is a lazy table."""

    molecules: DataFrame
    #: Thinned tags of excluded genes, if any are excluded.
    excluded: DataFrame | None = None
    #: How many molecules of each seed, fraction, class and validity have how many reads (total): n, in some rows each. Far fewer rows than molecules.
    tallies: DataFrame | None = None

    def bulk(self) -> DataFrame:
        """Totals of each seed and fraction; with excluded genes, their reads too."""
        found = summaries.bulk(self.molecules)
        return found if self.excluded is None else summaries.with_excluded(found, self.excluded)

    def by_class(self) -> DataFrame:
        return summaries.by_class(self.molecules)

    def by_sample(self, samples: DataFrame) -> DataFrame:
        """bulk for each sample of (barcode, sample); with excluded genes, their reads too."""
        found = summaries.bulk_by(self.molecules.join(samples, "barcode"), "sample")
        return found if self.excluded is None else summaries.with_excluded(found, self.excluded.join(samples, "barcode"), "sample")

    def histogram(self, bins: int = 50, *keys: str, tail: bool = True) -> DataFrame:
        found = summaries.reads_histogram(self.molecules, bins, *keys)
        return found if tail else found.where(F.col("bin") < bins)

    def barcodes(self) -> DataFrame:
        return summaries.barcode_stats(self.molecules)

    def barcode_classes(self, masks: DataFrame | None = None) -> DataFrame:
        """Reads, molecules, genes, mitochondrial and module molecules of each barcode, in total and by class; masks from summaries.gene_masks."""
        return summaries.barcode_classes(self.molecules, masks)

    def matrix(self) -> DataFrame:
        return summaries.total_matrix(self.molecules)

    def class_matrices(self) -> DataFrame:
        return summaries.class_matrices(self.molecules)

    def compressed(self, seed: int, frac_idx: int, kind: str | None = None, rows: DataFrame | None = None, columns: DataFrame | None = None) -> matrices.Compressed:
        """One matrix in compressed rows, in total or of a class; `rows` (barcode) and `columns` (gene) may name a subset, or keys without entries."""
        return matrices.from_sample(self.matrix() if kind is None else self.class_matrices(), seed, frac_idx, kind, rows, columns)

    def csr(self, seed: int, frac_idx: int, most: int = 50_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Barcodes, row starts, genes and values of one matrix, in the driver; it may have `most` entries."""
        entries = kept(self.matrix().where((F.col("seed") == seed) & (F.col("frac_idx") == frac_idx)).select("barcode", "gene", "value"))
        if (n := entries.count()) > most:
            raise ValueError(f"{n} entries; at most {most} go to the driver")
        rows = entries.orderBy("barcode", "gene").toPandas()
        barcodes, starts = np.unique(rows["barcode"].to_numpy(), return_index=True)
        return barcodes, np.append(starts, n), rows["gene"].to_numpy(), rows["value"].to_numpy()


@dataclass
class Depth:
    """A molecule table (barcode, gene, umi and reads of three classes; random_hex if it has primers), ready to be thinned."""

    tags: DataFrame
    umi_length: int
    excluded: DataFrame | None = None

    def downsample(self, fracs: Sequence[float], seeds: Sequence[int] = (42,), umi_mode: str = "directed", multi_gene: bool = True, primers: str = "merge") -> Sample:
        if umi_mode not in ("directed", "none") or primers not in ("merge", "poly_a", "random_hex"):
            raise ValueError(f"unknown mode: {umi_mode}, {primers}")
        if any(f <= 0 for f in fracs):
            raise ValueError("fractions are above 0")
        # Fractions above 1, as a grid of targets may have, can't be drawn and are left out.
        if not (fracs := [f for f in fracs if f <= 1]):
            raise ValueError("no fraction is at most 1")
        tags = self.tags
        if "random_hex" in tags.columns and primers != "merge":
            tags = tags.where(F.col("random_hex") == F.lit(primers == "random_hex"))
        tags = tags.groupBy("barcode", "gene", "umi").agg(*[F.sum(c).alias(c) for c in thinning.CLASSES])
        out = None
        if self.excluded is not None:
            genes = self.excluded.select("gene").distinct()
            out, tags = thinning.thin(tags.join(genes, "gene", "left_semi"), fracs, list(seeds), exact=False), tags.join(genes, "gene", "left_anti")
        packed = molecules.thinned_and_collapsed(tags, fracs, list(seeds), self.umi_length if umi_mode == "directed" else None)
        return Sample(molecules.with_validity(packed, fracs, multi_gene), out, molecules.with_validity(packed, fracs, multi_gene, tallied=True))
