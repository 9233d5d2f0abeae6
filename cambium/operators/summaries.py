"""Totals, histograms, matrices and per-barcode statistics of a molecule table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def molecule_class() -> Column:
    return F.expr("CASE WHEN spliced > 0 THEN 'spliced' WHEN unspliced > 0 THEN 'unspliced' ELSE 'ambiguous' END")


def tally(molecules: DataFrame) -> DataFrame:
    """n molecules of each seed, fraction, class, validity and total, one row each; of molecules, or of a tally in several rows. `bulk`, `by_class` and `reads_histogram` take it in place of molecules."""
    kind = F.col("class") if "class" in molecules.columns else molecule_class().alias("class")
    return molecules.groupBy("seed", "frac_idx", kind, "valid", "total").agg(F.sum(_times(molecules)).alias("n"))


def _times(molecules: DataFrame) -> Column:
    """How many molecules a row stands for."""
    return F.col("n") if "n" in molecules.columns else F.lit(1).cast("long")


def bulk(molecules: DataFrame) -> DataFrame:
    """Reads and molecules of each seed and fraction, kept and discarded, and the saturation."""
    return bulk_by(molecules)


def bulk_by(molecules: DataFrame, *keys: str) -> DataFrame:
    n = _times(molecules)
    found = molecules.groupBy("seed", "frac_idx", *keys).agg(
        F.sum(F.when(F.col("valid"), F.col("total") * n).otherwise(0)).alias("reads"),
        F.sum(F.when(F.col("valid"), n).otherwise(0)).alias("molecules"),
        F.sum(F.when(~F.col("valid"), F.col("total") * n).otherwise(0)).alias("reads_discarded"),
        F.sum(F.when(~F.col("valid"), n).otherwise(0)).alias("molecules_discarded"),
    )
    return found.withColumn("saturation", F.round(100 - 100 * F.col("molecules") / F.col("reads"), 6))


def with_excluded(totals: DataFrame, tags: DataFrame, *keys: str) -> DataFrame:
    """Adds reads_excluded, of the thinned tags of excluded genes, to totals of each seed and fraction (and other keys)."""
    out = tags.groupBy("seed", "frac_idx", *keys).agg(F.sum(F.expr("spliced + unspliced + ambiguous")).alias("reads_excluded"))
    return totals.join(out, ["seed", "frac_idx", *keys], "left").fillna(0, ["reads_excluded"])


CLASSES = ("spliced", "unspliced", "ambiguous")


def gene_masks(genes: DataFrame, mt_prefix: str | None = None, mt_ids: DataFrame | None = None, module_ids: DataFrame | None = None) -> DataFrame:
    """gene, mt and module of genes (gene, gene_id, gene_name): mitochondrial by the beginning of the name or by a list of ids (gene_id), and in a module by a list."""
    if mt_prefix and mt_ids is not None:
        raise ValueError("mitochondrial genes are named by a prefix or by a list, not both")
    found = genes.withColumns({"mt": F.col("gene_name").startswith(mt_prefix) if mt_prefix else F.lit(False), "module": F.lit(False)})
    for name, ids in (("mt", mt_ids), ("module", module_ids)):
        if ids is not None:
            listed = ids.select("gene_id").distinct().withColumn("__in", F.lit(True))
            found = found.join(listed, "gene_id", "left").withColumn(name, F.col("__in").isNotNull()).drop("__in")
    return found.select("gene", "mt", "module")


def barcode_classes(molecules: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """For each seed, fraction and barcode the reads, molecules, genes, mitochondrial and module molecules, in total and of each class; of valid molecules.

    All reads of a molecule count for its class. Genes are counted after a sum by gene, so nothing distinct is kept.
    """
    kind = molecule_class()
    of = {"total": F.lit(True)} | {c: kind == c for c in CLASSES}
    by_gene = molecules.where("valid").groupBy("seed", "frac_idx", "barcode", "gene").agg(
        *[F.count_if(test).alias(f"{c}_molecules") for c, test in of.items()], *[F.sum(F.when(test, F.col("total")).otherwise(0)).alias(f"{c}_reads") for c, test in of.items()]
    )
    if masks is None:
        marked = by_gene.withColumns({"mt": F.lit(False), "module": F.lit(False)})
    else:
        marked = by_gene.join(masks, "gene", "left").fillna(False, ["mt", "module"])
    sums = []
    for c in of:
        n = F.col(f"{c}_molecules")
        sums += [F.sum(f"{c}_reads").alias(f"{c}_reads"), F.sum(n).alias(f"{c}_molecules"), F.count_if(n > 0).alias(f"{c}_genes")]
        sums += [F.sum(F.when(F.col(m), n).otherwise(0)).alias(f"{c}_{m}") for m in ("mt", "module")]
    return marked.groupBy("seed", "frac_idx", "barcode").agg(*sums)


def spatial_bin_sums(barcodes: DataFrame, positions: DataFrame, rows: int, cols: int, row_div: int, col_div: int) -> DataFrame:
    """Every bin of the grid with the sums, over its barcodes, of all numbers of `barcodes` (barcode and others) and of `positions` (barcode, array_row, array_col, and say countable and total reads)."""
    if row_div < 2 and col_div < 2:
        raise ValueError("one of the divisors must be at least 2")
    wide = -(-cols // col_div)
    placed = positions.withColumn("bin_idx", (F.floor(F.col("array_row") / row_div) * wide + F.floor(F.col("array_col") / col_div)).cast("long")).drop("array_row", "array_col")
    both = placed.join(barcodes, "barcode", "left")
    names = [c for c in both.columns if c not in ("barcode", "bin_idx", "seed", "frac_idx")]
    sums = both.groupBy("bin_idx").agg(F.count(F.lit(1)).alias("n_barcodes"), *[F.sum(c).alias(c) for c in names])
    grid = barcodes.sparkSession.range(-(-rows // row_div) * wide).withColumnRenamed("id", "bin_idx")
    return grid.join(sums, "bin_idx", "left").fillna(0)


def by_class(molecules: DataFrame) -> DataFrame:
    """Of valid molecules; all reads of a molecule count for its class."""
    n, kind = _times(molecules), F.col("class") if "class" in molecules.columns else molecule_class().alias("class")
    return molecules.where("valid").groupBy("seed", "frac_idx", kind).agg(F.sum(F.col("total") * n).alias("reads"), F.sum(n).alias("molecules"))


def reads_histogram(molecules: DataFrame, bins: int, *keys: str) -> DataFrame:
    """Molecules by their number of reads; the last bin has those with more too."""
    return molecules.where("valid").groupBy("seed", "frac_idx", *keys, F.least("total", F.lit(bins)).alias("bin")).agg(F.sum(_times(molecules)).alias("n"))


def barcode_stats(molecules: DataFrame) -> DataFrame:
    return molecules.where("valid").groupBy("seed", "frac_idx", "barcode").agg(F.sum("total").alias("reads"), F.count(F.lit(1)).alias("molecules"), F.countDistinct("gene").alias("genes"))


def total_matrix(molecules: DataFrame) -> DataFrame:
    """Valid molecules by barcode and gene; a gene all of whose molecules were discarded has an explicit 0."""
    return molecules.groupBy("seed", "frac_idx", "barcode", "gene").agg(F.count_if("valid").alias("value"))


def class_matrices(molecules: DataFrame) -> DataFrame:
    return molecules.where("valid").groupBy("seed", "frac_idx", "barcode", "gene", molecule_class().alias("class")).agg(F.count(F.lit(1)).alias("value"))


def spatial_bins(molecules: DataFrame, positions: DataFrame, rows: int, cols: int, row_div: int, col_div: int) -> DataFrame:
    """Every bin of the grid, empty ones too, with sums over its barcodes and its number of distinct genes."""
    if row_div < 2 and col_div < 2:
        raise ValueError("one of the divisors must be at least 2")
    wide = -(-cols // col_div)
    placed = positions.withColumn("bin_idx", (F.floor(F.col("array_row") / row_div) * wide + F.floor(F.col("array_col") / col_div)).cast("long"))
    tops = placed.groupBy("bin_idx").agg(F.count(F.lit(1)).alias("n_barcodes"), F.count_if(F.col("in_tissue") > 0).alias("in_tissue"))
    seen = molecules.where("valid").join(placed.select("barcode", "bin_idx"), "barcode").groupBy("bin_idx").agg(
        F.sum("total").alias("reads"), F.count(F.lit(1)).alias("molecules"), F.countDistinct("gene").alias("genes")
    )
    grid = molecules.sparkSession.range(-(-rows // row_div) * wide).withColumnRenamed("id", "bin_idx")
    found = grid.join(tops, "bin_idx", "left").join(seen, "bin_idx", "left")
    return found.select("bin_idx", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_barcodes", "in_tissue", "reads", "molecules", "genes")])


def filtered_bins(molecules: DataFrame, placed: DataFrame, chosen: DataFrame) -> DataFrame:
    """Molecules of each gene in the chosen bins; `placed` has barcode and bin_idx, `chosen` bin_idx."""
    inside = placed.join(chosen.select("bin_idx"), "bin_idx", "left_semi").select("barcode", "bin_idx")
    return molecules.where("valid").join(inside, "barcode").groupBy("bin_idx", "gene").agg(F.count(F.lit(1)).alias("value"))
