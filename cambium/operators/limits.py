"""How well fits of part of the reads predict the rest: limits of saturation, and pilots of few reads a cell or share of tissue.

All seeds, limits and pilot depths are thinned in one plan. Each fit is held
against the curve of its own seed, the points of which are the limits. Tables
are long: a row for each seed and step, for each point that a fit predicts, and
for each bin of a histogram.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import library
from ..session import kept
from .curves import prediction_errors
from .fit_products import CLASSES, sized, steps
from .fitting import fit_histograms
from .summaries import bulk, by_class, reads_histogram, tally

# How many times the area of the small capture format each format has.
CAPTURE_SCALE = {"6.5mm": 1.0, "11mm": 2.87}
#: Powers of ten of the reads a cell, and a whole slide, at which pilots begin and end.
CELL_DECADES, TISSUE_DECADES = (2, 5), (6, 8)


def saturation_limits(fit: DataFrame, countable: int, last: float, first: float = 10, step: float = 5) -> list[tuple[float, float]]:
    """(saturation, fraction of the countable reads) from `first` up to `last` percent at which the fitted model (one row: size, r) has them; those that all reads suffice for.

    Empty if the fit failed (null size) or saturation stays below `first`.
    """
    if step <= 0:
        raise ValueError("the step of saturations is above 0")
    if last < first:
        return []
    # At most 100 / step rows.
    asked = fit.where("size IS NOT NULL").limit(1).withColumn("at", F.explode(steps(first, last, step))).withColumn("needed", library.reads_for_saturation("at", "size", "r"))
    found = sorted((r["at"], r["needed"] / countable) for r in asked.select("at", "needed").collect() if r["needed"])
    return [(at, fraction) for at, fraction in found if fraction <= 1]


@dataclass
class Pilot:
    """Depths of a pilot: reads of 1, 2 and 5 times each power of ten for each cell, or for a slide that is wholly covered."""

    countable: int
    cells: float | None = None
    tissue: float | None = None
    #: A factor more; of tissue, the capture format's if none is given.
    scale: float | None = None
    capture: str | None = None
    decades: tuple[int, int] | None = None

    def __post_init__(self):
        if (self.cells is None) == (self.tissue is None):
            raise ValueError("a pilot has a number of cells or a share of tissue")
        if self.tissue is not None and not 0 < self.tissue <= 1:
            raise ValueError("the share of tissue is above 0 and at most 1")
        if self.cells is not None and self.cells <= 0:
            raise ValueError("the number of cells is above 0")
        if self.scale is None:
            self.scale = 1.0 if self.cells is not None else CAPTURE_SCALE.get(self.capture, 1.0)
        if self.scale <= 0:
            raise ValueError("scales are above 0")
        if self.decades is None:
            self.decades = CELL_DECADES if self.cells is not None else TISSUE_DECADES

    def depths(self) -> list[tuple[int, int, float]]:
        """(reads a unit, reads, fraction) of the depths that all reads suffice for."""
        units = (self.tissue if self.cells is None else self.cells) * self.scale
        grid = [m * 10**d for d in range(self.decades[0], self.decades[1] + 1) for m in (1, 2, 5)]
        found = [(unit, round(unit * units), round(unit * units) / self.countable) for unit in grid]
        return [(unit, reads, fraction) for unit, reads, fraction in found if 0 < fraction <= 1]


@dataclass
class Tables:
    """`unit` is the reads a cell or slide of a pilot, null for limits; `limit` the saturation of a limit, the reads of a pilot."""

    #: seed, curve_index, frac_idx, limit, unit, fraction: reads and molecules, in total, of each class and discarded; saturation and downsampled_frac.
    stats: DataFrame
    #: seed, curve_index, frac_idx, limit, unit, fraction: the fit, its distance and likelihood, the library's size, and the mean error of the saturation in points.
    summary: DataFrame
    #: A row for each fit and point of its seed's curve: reads, and the saturation seen and predicted.
    curves: DataFrame
    #: seed, curve_index, frac_idx, bin from 1 to one below the last, n (0 where no molecule has so many reads).
    histograms: DataFrame
    #: Medians over seeds for each limit, or reads a unit: distance, error, saturation and reads, and the fits that failed.
    medians: DataFrame


def _tables(totals: DataFrame, histograms: DataFrame, truth: DataFrame, named: DataFrame, curve_of: DataFrame, max_hist: int, by: str) -> Tables:
    stats = totals.join(F.broadcast(named), "frac_idx").join(F.broadcast(curve_of), "seed")  # given lists
    fits = kept(sized(fit_histograms(histograms, "seed", "frac_idx", bins=max_hist - 1).join(stats, ["seed", "frac_idx"])))
    points = truth.select("seed", F.col("frac_idx").alias("point"), "reads", F.col("molecules").alias("seen"), F.col("saturation").alias("seen_saturation"))
    keys = ("seed", "curve_index", "frac_idx", "limit", "unit")
    curves = kept(prediction_errors(fits.select(*keys, "size", "r").join(points, "seed")))
    errors = curves.groupBy("seed", "frac_idx").agg(F.avg("saturation_err").alias("mae"))
    wanted = (*keys, "fraction", "ks", "nll_per_molecule", "tail_mass", "failed", "r", "p", "size", "saturation", "reads", "molecules")
    summary = kept(fits.select(*wanted).join(errors, ["seed", "frac_idx"], "left"))
    bins = named.select("frac_idx").join(curve_of, how="cross").withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(max_hist - 1))))  # given lists
    counted = histograms.select("seed", "frac_idx", F.col("bin").cast("int").alias("bin"), "n")
    filled = bins.join(counted, ["seed", "frac_idx", "bin"], "left").fillna(0, ["n"])
    medians = summary.groupBy(by).agg(*[F.median(c).alias(c) for c in ("ks", "mae", "saturation", "reads")], F.count_if("failed").alias("failed"), F.count(F.lit(1)).alias("fits"))
    named_curves = curves.select(*keys, "point", "reads", "seen_saturation", F.col("saturation").alias("predicted_saturation"), "saturation_err")
    return Tables(stats, summary, named_curves, filled.select("seed", "curve_index", "frac_idx", "bin", "n"), medians)


def products(measure: Callable[[list[float]], DataFrame], seeds: Sequence[int], limits: Sequence[tuple[float | None, float]], countable: int, max_hist: int = 50, pilot: Pilot | None = None, excluded: Callable[[DataFrame], DataFrame] | None = None) -> tuple[Tables, Tables | None]:
    """The tables of limits (saturation, fraction), and of a pilot's depths if one is given and has any.

    `measure` gives the molecules, or their tallies, of a list of fractions for
    all seeds, in one plan; only a tally of them is written. Fits that fail keep their row, without size, predictions and error; a
    seed without a molecule at a step has no row there. `excluded` may add to the
    totals of each seed and fraction.
    """
    if not limits:
        raise ValueError("there are no limits")
    depths = pilot.depths() if pilot is not None else []
    fractions = [f for _, f in limits] + [f for _, _, f in depths]
    if not all(0 < f <= 1 for f in fractions):
        raise ValueError("fractions are above 0 and at most 1")
    found = kept(tally(measure(fractions)))
    spark, n = found.sparkSession, len(limits)
    rows = [(i, None if at is None else float(at), None, float(f)) for i, (at, f) in enumerate(limits)] + [(n + i, float(reads), unit, float(f)) for i, (unit, reads, f) in enumerate(depths)]
    named = spark.createDataFrame(rows, "frac_idx int, limit double, unit long, fraction double")
    curve_of = spark.createDataFrame([(int(s), i) for i, s in enumerate(seeds)], "seed long, curve_index int")
    classes = by_class(found).groupBy("seed", "frac_idx").pivot("class", list(CLASSES)).agg(F.first("reads").alias("reads"), F.first("molecules").alias("molecules"))
    totals = bulk(found)
    totals = (totals if excluded is None else excluded(totals)).join(classes, ["seed", "frac_idx"], "left").fillna(0)
    out = F.col("reads_excluded") if "reads_excluded" in totals.columns else F.lit(0)
    totals = kept(totals.withColumn("downsampled_frac", (F.col("reads") + F.col("reads_discarded") + out) / countable))
    histograms = kept(reads_histogram(found, max_hist))
    first = F.col("frac_idx") < n
    truth = totals.where(first)
    whole = _tables(truth, histograms.where(first), truth, named.where(first), curve_of, max_hist, "limit")
    if not depths:
        return whole, None
    return whole, _tables(totals.where(~first), histograms.where(~first), truth, named.where(~first), curve_of, max_hist, "unit")


def pilot_summary(pilot: Pilot, tables: Tables) -> DataFrame:
    """One row for each curve: what its pilot was, and the least and most reads and fractions of it."""
    given = {"mode": "cells" if pilot.cells is not None else "tissue", "cells": pilot.cells, "tissue": pilot.tissue, "capture": pilot.capture, "scale": pilot.scale, "first_decade": pilot.decades[0], "last_decade": pilot.decades[1]}
    kinds = {"mode": "string", "cells": "double", "tissue": "double", "capture": "string", "scale": "double", "first_decade": "int", "last_decade": "int"}
    spans = [f(c).alias(f"{c}_{end}") for c in ("unit", "limit", "fraction") for end, f in (("min", F.min), ("max", F.max))]
    return tables.stats.groupBy("seed", "curve_index").agg(*spans).withColumns({k: F.lit(v).cast(kinds[k]) for k, v in given.items()})
