"""Command line: python -m cambium.cli COMMAND; tables are Parquet folders under a prefix."""

from __future__ import annotations

import argparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Depth, barcode_index, genes_of, molecule_tags, raw_reads
from .functions import library as model
from .operators import cells, classify, curves, droplets, fit_products, limits, replicates, stability, summaries
from .session import kept
from .sources import binary, files, libraries


def seeds_of(seed: int, repeats: int) -> list[int]:
    return [int(s) for s in np.random.default_rng(seed).choice(2**32, size=repeats, replace=False)]


def save(df: DataFrame, args: argparse.Namespace, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{args.prefix}_{name}.parquet")


def saved(spark: SparkSession, args: argparse.Namespace, name: str) -> DataFrame | None:
    """A table that another command has written, if it has."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{args.prefix}_{name}.parquet")
    return spark.read.parquet(str(path.toString())) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None


def libraries_of(args: argparse.Namespace) -> dict[str, tuple]:
    return libraries.custom(args.custom_libs, args.override) if args.custom_libs else libraries.BUILT_IN


def baseline_fraction(spark: SparkSession, args: argparse.Namespace) -> float:
    """That of the saved fit; all reads if there is none."""
    found = saved(spark, args, "fit_baseline")
    return 1.0 if found is None else found.first()["fraction"]


def depth(spark: SparkSession, args: argparse.Namespace) -> Depth:
    tags = spark.read.parquet(f"{args.prefix}_tags.parquet")
    out = None
    if args.exclude_genes:
        ids = files.read_gene_list(spark, args.exclude_genes)
        out = spark.read.parquet(f"{args.prefix}_genes.parquet").join(ids, "gene_id", "left_semi")
    return Depth(tags, libraries_of(args)[args.library][libraries.FIELDS.index("UR_length")], out)


def known_libraries(spark: SparkSession, args: argparse.Namespace) -> None:
    libraries.catalogue(spark, libraries.custom(args.custom_libs, args.override) if args.custom_libs else None).show(1000, truncate=False)


def cache(spark: SparkSession, args: argparse.Namespace) -> None:
    spec = libraries_of(args)[args.library]
    named = dict(zip(libraries.FIELDS, spec))
    wanted = {"cb": named["CB_tag"], "umi": named["UR_tag"], "gx": "GX"} | ({"sample": args.sample_tag} if args.samples else {})
    reads = (binary.read_bam if args.alignments.endswith(".bam") else files.read_sam)(spark, args.alignments, wanted)
    genes = kept(genes_of(files.read_gtf(spark, args.annotation)))
    judged = kept(raw_reads(reads, genes, spec, args.least_quality, args.known_junctions, args.samples.split(",") if args.samples else None))
    tags = kept(molecule_tags(judged))
    save(judged.groupBy("status", "random_hex").agg(F.count(F.lit(1)).alias("n")), args, "summary")
    save(genes, args, "genes")
    index = kept(barcode_index(judged, tags))
    save(index.withColumn("sample", F.substring_index("cb", "_", 1)) if args.samples else index, args, "barcodes")
    primers = bool(named["random_hex_re"])
    totals = index.agg(F.coalesce(F.sum("raw_molecules"), F.lit(0)), F.count(F.lit(1))).first()
    given = [("raw_molecules", "reads", totals[0]), ("alignments", "param", args.alignments), ("least_quality", "param", args.least_quality), ("known_junctions", "param", int(args.known_junctions))]
    given += [("library", "library", args.library), *[(field, "library", named[field]) for field in libraries.FIELDS if named[field] is not None], ("barcodes_detected", "library", totals[1])]
    save(classify.read_summary(judged, primers).unionByName(spark.createDataFrame([(k, t, str(v)) for k, t, v in given], "key string, type string, value string")), args, "summary_table")
    if args.samples:
        save(classify.read_summary(judged.where(F.col("sample").isin(args.samples.split(","))), primers, "sample"), args, "sample_summary")
    files.write_tags(tags.join(index.select("cb", "barcode"), "cb").drop("cb"), f"{args.prefix}_tags.parquet")


def positions(spark: SparkSession, args: argparse.Namespace) -> None:
    save(files.read_positions(spark, args.positions), args, "positions")


def probes(spark: SparkSession, args: argparse.Namespace) -> None:
    table = spark.read.csv(args.probes, header=True, comment="#").withColumn("included", F.lower("included") == "true")
    files.excluded_probes(table).orderBy("gene_id").coalesce(1).write.mode("overwrite").text(f"{args.prefix}_exclude")


def masks(spark: SparkSession, args: argparse.Namespace) -> DataFrame | None:
    """Mitochondrial and module genes, if any are named."""
    if not (args.mt_prefix or args.mt_file or args.mod_file):
        return None
    ids = lambda path: files.read_gene_list(spark, path) if path else None
    return summaries.gene_masks(spark.read.parquet(f"{args.prefix}_genes.parquet"), args.mt_prefix, ids(args.mt_file), ids(args.mod_file))


def emptydrops(spark: SparkSession, args: argparse.Namespace) -> None:
    sample = depth(spark, args).downsample([1.0])
    sample.molecules = kept(sample.molecules)
    save(sample.barcode_classes(masks(spark, args)), args, "emptydrops_raw")
    counts = sample.matrix().select("barcode", "gene", "value")
    options = {"lower": args.lower, "retain": args.retain or None, "iterations": args.iterations, "seed": args.seed, "most_fdr": args.fdr}
    barcodes = spark.read.parquet(f"{args.prefix}_barcodes.parquet") if args.by_sample else None
    if barcodes is None:
        save(droplets.droplet_calls(counts, **options), args, "emptydrops")
    else:
        named = barcodes.select("barcode", F.substring_index("cb", "_", 1).alias("sample"))
        save(droplets.calls_by(counts.join(named, "barcode"), "sample", **options), args, "emptydrops")


def fit(spark: SparkSession, args: argparse.Namespace) -> None:
    whole = depth(spark, args)
    countable = whole.tags.agg(F.sum(F.expr("spliced + unspliced + ambiguous"))).first()[0] or 0
    summary = saved(spark, args, "summary")
    total = summary.agg(F.sum("n")).first()[0] if summary is not None else countable
    classes = not libraries_of(args)[args.library][libraries.FIELDS.index("probe_based")]
    found = fit_products.products(lambda fracs: whole.downsample(fracs, [args.seed]).molecules, countable, total, args.baseline_sat, args.max_sat, args.points, args.max_hist, args.sat_start, args.sat_end, args.sat_step, classes)
    if found is None:
        raise SystemExit("no fit: there are no molecules")
    for name, table in vars(found).items():
        save(table, args, f"fit_{'rpm_histograms' if name == 'histograms' else name}")


def passed_barcodes(spark: SparkSession, args: argparse.Namespace) -> DataFrame | None:
    """Those that the filter command let pass, if it has run."""
    found = saved(spark, args, "passed")
    return None if found is None else found.where("passed > 0").select("barcode")


def pilot_of(spark: SparkSession, args: argparse.Namespace, countable: int) -> limits.Pilot | None:
    n = args.cells or None
    if n is None and args.use_scrna:
        if (chosen := passed_barcodes(spark, args)) is None:
            raise SystemExit("no cells: run filter first")
        n = chosen.count()
    if n is None and not args.tissue_frac:
        return None
    decades = limits.CELL_DECADES if n is not None else limits.TISSUE_DECADES
    ends = (decades[0] if args.base_start < 0 else args.base_start, decades[1] if args.base_end < 0 else args.base_end)
    scale = args.cell_scale if n is not None else args.tissue_scale
    return limits.Pilot(countable, n, None if n is not None else args.tissue_frac, scale or None, args.capture_format, ends)


def limit(spark: SparkSession, args: argparse.Namespace) -> None:
    """Fits at each limit of saturation, against the curve of their seed; without a saved fit, at even fractions."""
    whole = depth(spark, args)
    seeds = seeds_of(args.seed, args.repeats)
    countable = whole.tags.agg(F.sum(F.expr("spliced + unspliced + ambiguous"))).first()[0] or 0
    if not countable:
        raise SystemExit("no limits: there are no molecules")
    asked: list[tuple[float | None, float]] = []
    if (baseline := saved(spark, args, "fit_baseline")) is not None:
        asked = limits.saturation_limits(baseline, countable, baseline.first()["full_saturation"], args.sat_start, args.sat_step)
    pilot = pilot_of(spark, args, countable)

    taken = []

    def measure(fractions: list[float]) -> DataFrame:
        taken.append(whole.downsample(fractions, seeds))
        return taken[-1].molecules

    def excluded(totals: DataFrame) -> DataFrame:
        return totals if taken[-1].excluded is None else summaries.with_excluded(totals, taken[-1].excluded)

    found, few = limits.products(measure, seeds, asked or [(None, f) for f in curves.curve_fractions(args.points)], countable, args.max_hist, pilot, excluded)
    for name, table in vars(found).items():
        save(table, args, f"limit_{name}")
    if few is not None:
        for name, table in vars(few).items():
            save(table, args, f"pilot_{name}")
        save(limits.pilot_summary(pilot, few), args, "pilot_depths")


def preseq(spark: SparkSession, args: argparse.Namespace) -> None:
    histogram = kept(depth(spark, args).downsample([1.0], [args.seed]).histogram(1_000, tail=False))
    save(curves.extrapolate(histogram, "seed", "frac_idx", most=args.most), args, "preseq_curves")
    save(curves.least_size(histogram, "seed", "frac_idx"), args, "preseq_summary")


def genes(spark: SparkSession, args: argparse.Namespace) -> None:
    """How stable a barcode's genes are at each recovery of the library, those of 1, 2 and 3 or more molecules by themselves; without a saved fit, at even fractions."""
    whole = depth(spark, args)
    seeds = seeds_of(args.seed, args.repeats)
    countable = whole.tags.agg(F.sum(F.expr("spliced + unspliced + ambiguous"))).first()[0] or 0
    targets: list[tuple[float | None, float]] = []
    baseline = saved(spark, args, "fit_baseline")
    if baseline is not None and countable:
        recoveries = spark.createDataFrame([(float(r),) for r in sorted({float(r) for r in args.recoveries.split(",")})], "recovery double")
        needed = baseline.where("size IS NOT NULL").limit(1).select("size", "r").crossJoin(recoveries).select("recovery", (model.reads_for_recovery(F.col("recovery") / 100, F.col("size"), F.col("r")) / countable).alias("fraction"))
        targets = sorted((r["recovery"], r["fraction"]) for r in needed.where("fraction <= 1").collect())  # a given list
    targets = targets or [(None, f) for f in curves.curve_fractions(args.points)]
    full = whole.downsample([1.0], [args.seed])
    full.molecules = kept(full.molecules)
    repeats = whole.downsample([f for _, f in targets], seeds)
    repeats.molecules = kept(repeats.molecules)
    own, others = full.matrix().select("barcode", "gene", "value"), repeats.matrix()
    if (chosen := passed_barcodes(spark, args)) is not None:
        own, others = own.join(chosen, "barcode", "left_semi"), others.join(chosen, "barcode", "left_semi")
    names = spark.createDataFrame([(i, t, float(f)) for i, (t, f) in enumerate(targets)], "frac_idx int, recovery double, fraction double")
    all_reads = full.bulk().first()["reads"]
    stats = kept(repeats.bulk().join(F.broadcast(names), "frac_idx").withColumn("read_ratio", F.lit(all_reads) / F.col("reads")))
    save(stats, args, "genes_curve_stats")
    found = kept(stability.gene_class_stability(own, others, len(seeds), len(targets)))
    if args.write:
        save(found, args, "genes_barcodes")
    ratios = stats.groupBy("frac_idx").agg(F.avg("read_ratio").alias("ratio"))
    save(names.join(ratios, "frac_idx", "left").join(stability.gene_class_summary(found, args.min_obs), "frac_idx", "left"), args, "genes_summary")


def stable(spark: SparkSession, args: argparse.Namespace) -> None:
    """Of each two replicates: the Rand index of their communities at each resolution, and the overlap of their variable genes and neighbours."""
    whole = depth(spark, args)
    sample = kept(whole.downsample([args.frac or baseline_fraction(spark, args)], seeds_of(args.seed, args.repeats)).matrix())
    tables = {seed: sample.where(F.col("seed") == seed).select("barcode", "gene", "value") for seed in seeds_of(args.seed, args.repeats)}
    resolutions = sorted({float(r) for r in args.resolutions.split(",")})
    found = replicates.replicates(tables, resolutions, args.top_genes, args.components, args.neighbours, args.min_cells)
    pairs = kept(found.rand())
    save(pairs, args, "stability_pairs")
    save(pairs.groupBy("resolution").agg(F.median("ari").alias("median_ari"), F.avg("ari").alias("mean_ari"), F.count(F.lit(1)).alias("pairs")).orderBy("resolution"), args, "stability_summary")
    save(found.clusters(), args, "stability_clusters")
    save(found.gene_overlap(), args, "stability_genes")
    save(found.neighbour_overlap(), args, "stability_neighbours")


def filtered(spark: SparkSession, args: argparse.Namespace) -> None:
    """Barcodes that pass the filter of molecules and deviations, of those called as cells if there are calls."""
    called = spark.read.parquet(f"{args.prefix}_emptydrops.parquet").select("barcode", F.col("total").alias("molecules"), "is_cell")
    save(cells.mad_filter(called, args.least, args.mads), args, "passed")


COMMANDS = {
    "libraries": known_libraries, "cache": cache, "barcodes": positions, "probes": probes, "emptydrops": emptydrops, "filter": filtered,
    "fit": fit, "limit": limit, "preseq": preseq, "genes": genes, "stability": stable,
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cambium", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        one = sub.add_parser(name)
        one.add_argument("prefix", nargs="?" if name == "libraries" else None)
        one.add_argument("-l", "--library", default="10X_3p_v3")
        one.add_argument("--custom-libs")
        one.add_argument("--override", action="store_true")
        one.add_argument("--exclude-genes")
        one.add_argument("-S", "--seed", type=int, default=42)
        numbers = {
            "emptydrops": {"lower": 100, "retain": 0, "iterations": 10_000, "fdr": 0.01}, "filter": {"least": 500, "mads": 4.0}, "fit": {"points": 8, "max-hist": 50, "baseline-sat": 50.0, "max-sat": 55.0, "sat-start": 10.0, "sat-end": 95.0, "sat-step": 1.0}, 
            "limit": {"points": 10, "repeats": 10, "cells": 0.0, "max-hist": 50, "sat-start": 10.0, "sat-step": 5.0, "tissue-frac": 0.0, "tissue-scale": 0.0, "cell-scale": 0.0, "base-start": -1, "base-end": -1},
            "preseq": {"most": 10.0}, "genes": {"points": 10, "repeats": 10, "recoveries": "30,40,50,60,70", "min-obs": 10}, "cache": {"least-quality": 255},
            "stability": {"repeats": 5, "frac": 0.0, "top-genes": 2000, "components": 30, "neighbours": 30, "min-cells": 10, "resolutions": "1.0"},
        }
        for option, value in numbers.get(name, {}).items():
            one.add_argument(f"--{option}", type=type(value), default=value)
        if name == "emptydrops":
            for option in ("mt-prefix", "mt-file", "mod-file"):
                one.add_argument(f"--{option}")
            one.add_argument("--by-sample", action="store_true", help="each sample by itself; barcodes are named SAMPLE_SEQUENCE")
        if name == "limit":
            one.add_argument("--use-scrna", action="store_true", help="as many cells as the filter command let pass")
            one.add_argument("--capture-format", choices=sorted(limits.CAPTURE_SCALE))
        if name == "genes":
            one.add_argument("--write", action="store_true", help="write the table of barcodes too")
        if name == "cache":
            one.add_argument("--known-junctions", action="store_true", help="pass over reads with gaps that the annotation doesn't have")
            one.add_argument("--samples", help="names of samples, with commas between")
            one.add_argument("--sample-tag", default="CR")
        for option in {"cache": ("alignments", "annotation"), "barcodes": ("positions",), "probes": ("probes",)}.get(name, ()):
            one.add_argument(f"--{option}", required=True)
    return top


def main(words: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(words)
    COMMANDS[args.command](spark or SparkSession.builder.appName("cambium").getOrCreate(), args)


if __name__ == "__main__":
    main()
