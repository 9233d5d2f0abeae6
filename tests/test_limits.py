"""Limits of saturation, pilots, stability of genes by class and summaries of reads against plain versions."""

from collections import Counter, defaultdict
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from cambium.engine import Depth
from cambium.operators import classify, limits, stability, summaries


def library(spark, molecules=30_000, r=2.0, mean=6.0):
    """Molecules with reads drawn from a negative binomial, each of its own tag."""
    reads = np.random.default_rng(5).negative_binomial(r, r / (r + mean), molecules)
    rows = [(i % 50, i // 50, i % 4**6, int(n) if i % 2 else 0, 0, 0 if i % 2 else int(n)) for i, n in enumerate(reads) if n]
    return Depth(spark.createDataFrame(rows, "barcode long, gene long, umi long, spliced long, unspliced long, ambiguous long"), 6), int(reads.sum())


def test_limits_invert_the_model(spark):
    size, r, countable = 30_000.0, 2.0, 180_000
    fit = spark.createDataFrame([(size, r)], "size double, r double")
    found = limits.saturation_limits(fit, countable, 72.3, 10, 5)
    assert [at for at, _ in found] == [10.0 + 5 * i for i in range(13)]
    for at, fraction in found:
        n = fraction * countable
        assert 100 - 100 * size * (1 - (r / (r + n / size)) ** r) / n == pytest.approx(at, abs=1e-6)
    few = limits.saturation_limits(fit, 50_000, 72.3, 10, 5)
    assert few == [(at, pytest.approx(f * countable / 50_000)) for at, f in found if f * countable <= 50_000] and len(few) < 13
    assert limits.saturation_limits(fit, countable, 9, 10, 5) == [] == limits.saturation_limits(fit.withColumn("size", F.lit(None).cast("double")), countable, 50)
    with pytest.raises(ValueError):
        limits.saturation_limits(fit, countable, 50, 10, 0)


def test_pilot_depths():
    assert limits.Pilot(100_000, cells=40).depths() == [(100, 4000, 0.04), (200, 8000, 0.08), (500, 20000, 0.2), (1000, 40000, 0.4), (2000, 80000, 0.8)]
    assert [d[:2] for d in limits.Pilot(10_000_000, tissue=0.5, capture="11mm").depths()] == [(10**6, 1_435_000), (2 * 10**6, 2_870_000), (5 * 10**6, 7_175_000)]
    assert limits.Pilot(10_000_000, tissue=0.5, capture="11mm", scale=4.0).depths()[0] == (10**6, 2_000_000, 0.2)
    assert limits.Pilot(10, cells=40).depths() == []
    for wrong in ({}, {"cells": 1, "tissue": 0.5}, {"tissue": 1.5}, {"cells": 0}, {"cells": 1, "scale": -1.0}):
        with pytest.raises(ValueError):
            limits.Pilot(10, **wrong)


def test_limits_and_pilots_of_a_library(spark):
    whole, countable = library(spark)
    asked, seeds = [(20.0, 0.1), (40.0, 0.25), (None, 0.6)], [3, 9]
    pilot = limits.Pilot(countable, cells=50, decades=(2, 3))
    found, few = limits.products(lambda fracs: whole.downsample(fracs, seeds).molecules, seeds, asked, countable, 40, pilot)
    stats = {(r["seed"], r["frac_idx"]): r for r in found.stats.collect()}
    bulk = {(r["seed"], r["frac_idx"]): r for r in summaries.bulk(whole.downsample([f for _, f in asked], seeds).molecules).collect()}
    assert set(stats) == {(s, i) for s in seeds for i in range(3)} == set(bulk)
    for key, row in stats.items():
        assert (row["reads"], row["molecules"], row["saturation"]) == tuple(bulk[key][c] for c in ("reads", "molecules", "saturation"))
        assert row["spliced_reads"] + row["ambiguous_reads"] == row["reads"] and row["unspliced_reads"] == 0 and row["curve_index"] == seeds.index(key[0])
        assert row["downsampled_frac"] == pytest.approx(row["fraction"], rel=0.02)
    summary = found.summary.collect()
    # The library is of the model's own kind, so every fit predicts the whole curve.
    assert len(summary) == 6 and all(not r["failed"] and r["mae"] < 2 for r in summary) and all(r["size"] == pytest.approx(30_000, rel=0.2) for r in summary if r["frac_idx"] == 2)
    curves = found.curves.collect()
    assert Counter((r["seed"], r["frac_idx"], r["point"]) for r in curves) == Counter((s, i, j) for s in seeds for i in range(3) for j in range(3))
    errors = defaultdict(list)
    for r in curves:
        assert r["reads"] == bulk[r["seed"], r["point"]]["reads"]
        errors[r["seed"], r["frac_idx"]].append(abs(r["predicted_saturation"] - 100 + 100 * bulk[r["seed"], r["point"]]["molecules"] / r["reads"]))
    assert all(r["mae"] == pytest.approx(np.mean(errors[r["seed"], r["frac_idx"]])) for r in summary)
    bins = found.histograms.collect()
    assert len(bins) == 2 * 3 * 39 and sum(r["n"] for r in bins if r["frac_idx"] == 0) == sum(bulk[s, 0]["molecules"] for s in seeds)
    middle = {r["limit"]: r for r in found.medians.collect()}
    assert middle[20.0]["mae"] == pytest.approx(median(r["mae"] for r in summary if r["limit"] == 20.0)) and middle[None]["fits"] == 2
    depths = pilot.depths()
    assert [tuple(r) for r in few.stats.where("seed = 3").orderBy("frac_idx").select("unit", "limit", "fraction").collect()] == [(u, float(n), f) for u, n, f in depths] and depths
    assert few.curves.count() == 2 * len(depths) * 3 and few.medians.count() == len(depths)
    row = limits.pilot_summary(pilot, few).where("seed = 9").first()
    assert (row["curve_index"], row["mode"], row["cells"], row["unit_min"], row["unit_max"]) == (1, "cells", 50.0, depths[0][0], depths[-1][0])


def test_limits_without_a_fit(spark):
    """Molecules of one read each have no fit: rows stay, without size and error."""
    rows = spark.range(200).selectExpr("id % 4 AS barcode", "id % 9 AS gene", "id * 5 AS umi", "1L AS spliced", "0L AS unspliced", "0L AS ambiguous")
    found, few = limits.products(lambda fracs: Depth(rows, 6).downsample(fracs, [1]).molecules, [1], [(None, 0.5), (None, 1.0)], 200)
    assert few is None and [(r["failed"], r["size"], r["mae"]) for r in found.summary.where("failed").collect()] == [(True, None, None)] * found.summary.where("failed").count()
    assert found.summary.count() == 2 and found.medians.first()["fits"] == 2
    for wrong in ([], [(None, 1.5)]):
        with pytest.raises(ValueError):
            limits.products(lambda fracs: rows, [1], wrong, 200)


def test_gene_classes(spark):
    draw = np.random.default_rng(3)
    own = {(b, g): int(draw.integers(0, 5)) for b in range(6) for g in range(12) if draw.random() < 0.8}
    others = {(s, f, b, g): int(draw.integers(0, 2)) for s in (1, 2, 3) for f in (0, 1) for b in range(5) for g in range(14) if draw.random() < 0.5 + f / 4}
    others |= {(1, 0, 99, 1): 4}  # a barcode that the baseline doesn't have
    own[(7, 1)] = 0  # no gene at all
    base = spark.createDataFrame([(*k, v) for k, v in own.items()], "barcode long, gene long, value long")
    reps = spark.createDataFrame([(*k, v) for k, v in others.items()], "seed long, frac_idx int, barcode long, gene long, value long")
    found = {(r["frac_idx"], r["barcode"]): r for r in stability.gene_class_stability(base, reps, 3, 2).collect()}
    assert set(found) == {(f, b) for f in (0, 1) for b in range(6)}
    tests = {"": lambda v: v > 0, "_1": lambda v: v == 1, "_2": lambda v: v == 2, "_3p": lambda v: v >= 3}
    for (f, b), row in found.items():
        for c, test in tests.items():
            genes = {g for (bb, g), v in own.items() if bb == b and test(v)}
            shares = [len({g for g in genes if others.get((s, f, b, g), 0) > 0}) / len(genes) if genes else 0.0 for s in (1, 2, 3)]
            assert row[f"counts{c}"] == len(genes) and row[f"stability{c}"] == pytest.approx(sum(shares) / 3)
    summary = {r["frac_idx"]: r for r in stability.gene_class_summary(stability.gene_class_stability(base, reps, 3, 2), 3).collect()}
    for f in (0, 1):
        rows = [r for (g, _), r in found.items() if g == f]
        for c in tests:
            enough = [r[f"stability{c}"] for r in rows if r[f"counts{c}"] >= 3]
            assert summary[f][f"counts{c}"] == len(enough) and summary[f][f"fracs{c}"] == pytest.approx(100 * len(enough) / len(rows))
            assert summary[f][f"median_stability{c}"] == (pytest.approx(median(enough)) if enough else None)
            assert summary[f][f"genes{c}"] == median(r[f"counts{c}"] for r in rows)
    assert stability.gene_class_stability(base.where("false"), reps, 3, 2).count() == 0


def test_read_summary(spark):
    rows = [("s0", "countable", True), ("s0", "countable", False), ("s0", "no_gene", None), ("s1", "bad_tags", True), (None, "low_quality", False)]
    judged = spark.createDataFrame(rows, "sample string, status string, random_hex boolean")
    found = {r["key"]: (r["type"], int(r["value"])) for r in classify.read_summary(judged, True).collect()}
    assert found["total_reads"] == ("reads", 5) and found["polyA_total_reads"] == ("reads", 2) and found["random_hex_countable"] == ("reads", 1) and len(found) == 15
    by = {r["key"]: int(r["value"]) for r in classify.read_summary(judged, False, "sample").collect()}
    assert by == {f"{s}_{k}": sum(a == s and (k == "total_reads" or b == k) for a, b, _ in rows) for s in ("s0", "s1") for k in ("total_reads", "bad_tags", "low_quality", "countable", "no_gene")}
    assert {r["value"] for r in classify.read_summary(judged.where("false")).collect()} == {"0"} and classify.read_summary(judged.where("false"), False, "sample").count() == 0


def test_commands_spaced_by_the_fit(spark, tmp_path):
    """With a saved fit, limits are spaced by saturation and genes by recovery; the filter's barcodes are the cells."""
    from cambium import cli

    whole, countable = library(spark, 8_000)
    prefix = str(tmp_path / "x")
    whole.tags.withColumn("random_hex", F.lit(False)).write.parquet(f"{prefix}_tags.parquet")
    spark.createDataFrame([(b, int(b < 20)) for b in range(50)], "barcode long, passed int").write.parquet(f"{prefix}_passed.parquet")
    read = lambda name: spark.read.parquet(f"{prefix}_{name}.parquet")
    cli.main(["fit", prefix, "--points", "3", "--sat-step", "20"], spark)
    full = read("fit_baseline").first()["full_saturation"]
    cli.main(["limit", prefix, "--repeats", "2", "--sat-start", "20", "--sat-step", "20", "--use-scrna", "--base-start", "1", "--base-end", "2", "--cell-scale", "2"], spark)
    stats = read("limit_stats").collect()
    assert {r["limit"] for r in stats} == {at for at in (20.0, 40.0, 60.0, 80.0) if at <= full} and len(stats) >= 4
    assert all(r["saturation"] == pytest.approx(r["limit"], abs=4) for r in stats) and read("limit_medians").count() == len(stats) // 2
    assert {r["limit"] for r in read("pilot_stats").collect()} == {u * 40.0 for u in (10, 20, 50, 100, 200, 500) if u * 40 <= countable}
    row = read("pilot_depths").first()
    assert row["cells"] == 20.0 and row["scale"] == 2.0
    cli.main(["genes", prefix, "--repeats", "2", "--recoveries", "30,60", "--min-obs", "5", "--write"], spark)
    found = {r["recovery"]: r for r in read("genes_summary").collect()}
    assert set(found) == {30.0, 60.0} and read("genes_barcodes").select("barcode").distinct().count() == 20
    # Every gene of a barcode has one molecule here, so a gene is found again as often as a molecule.
    for recovery, r in found.items():
        assert r["median_stability_1"] == r["median_stability"] == pytest.approx(recovery / 100 * 8_000 / read("fit_baseline").first()["full_molecules"], abs=0.1)
        assert r["counts_2"] == 0 and r["median_stability_2"] is None and r["ratio"] > 1
