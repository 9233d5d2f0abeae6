"""Saturation curves: the fraction that reaches a target, and how well shallow fits predict a deep curve."""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import library
from ..session import kept
from .fitting import fit_histograms
from .summaries import bulk, reads_histogram

BINS = 50


def limit_errors(totals: DataFrame, histograms: DataFrame, truth: DataFrame) -> DataFrame:
    """For each seed and fraction its fit, library size and mean absolute error of the saturation over the seed's points of `truth`.

    Fits that failed keep their row, with `failed` set and neither size nor error.
    `totals` has seed, frac_idx, reads and molecules; `histograms` seed, frac_idx, bin and n; `truth` seed, reads and molecules, a few points a seed.
    """
    fits = fit_histograms(histograms, "seed", "frac_idx")
    sized = totals.select("seed", "frac_idx", "reads", "molecules").join(fits, ["seed", "frac_idx"])
    sized = sized.withColumn("size", F.when(~F.col("failed"), library.library_size(F.col("reads"), F.col("r"), F.col("p"))))
    points = truth.select("seed", F.col("reads").alias("at"), F.col("molecules").alias("seen"))
    both = sized.join(points, "seed")
    predicted = library.saturation(F.col("at"), library.molecules(F.col("at"), F.col("size"), F.col("r")))
    error = F.abs(predicted - library.saturation(F.col("at"), F.col("seen")))
    return both.groupBy("seed", "frac_idx", "r", "p", "ks", "failed", "size").agg(F.avg(error).alias("mae"), F.count(F.lit(1)).alias("points"))


def prediction_errors(points: DataFrame) -> DataFrame:
    """Adds what the model predicts at each point (reads, size, r) and how far off it is from the molecules `seen` there: in percent of them, and in points of saturation and recovery."""
    found = points.withColumns(library.predictions("reads", "size", "r"))
    return found.withColumns({
        "molecules_pdiff": 100 * F.abs(F.col("seen") - F.col("molecules")) / F.col("seen"),
        "saturation_err": F.abs(F.col("saturation") - library.saturation(F.col("reads"), F.col("seen"))),
        "recovery_err": F.abs(F.col("recovery") - 100 * F.col("seen") / F.col("size")),
    })


def target_fraction(measure: Callable[[float], DataFrame], countable: int, target: float = 50.0, most: float = 55.0) -> float:
    """The fraction of reads at which saturation reaches `target` percent; 1 if all reads don't reach `most`.

    `measure` gives the valid and discarded molecules of a fraction. A fit of
    all reads gives a first fraction, a fit of that fraction the final one.
    """
    needed = ("seed", "frac_idx", "total", "valid")
    molecules = kept(measure(1.0).select(*needed))
    whole = bulk(molecules).first()
    if whole is None or whole["saturation"] is None or whole["saturation"] < most:
        return 1.0
    frac = 1.0
    for _ in range(2):
        found = limit_errors(bulk(molecules), reads_histogram(molecules, BINS), bulk(molecules))
        row = found.withColumn("target", F.lit(target)).withColumn("wanted", library.reads_for_saturation("target", "size", "r")).first()
        if row is None or row["size"] is None or row["wanted"] is None:
            break
        frac = min(1.0, row["wanted"] / countable)
        molecules = kept(measure(frac).select(*needed))
    return frac


def curve_fractions(points: int, most: float = 1.0) -> list[float]:
    """Evenly spaced fractions up to `most`, which is the last."""
    return [most * i / points for i in range(1, points + 1)]


def pilot_fractions(countable: int, units: float, decades: tuple[int, int] = (2, 6)) -> list[float]:
    """Of 1, 2 and 5 reads of each power of ten a unit (a cell or a share of tissue), those fractions that all reads suffice for."""
    grid = [m * 10**d * units / countable for d in range(decades[0], decades[1] + 1) for m in (1, 2, 5)]
    return [f for f in grid if f <= 1.0]


def pilot_grid(units: DataFrame, decades: tuple[int, int] = (2, 6)) -> DataFrame:
    """For each row of `units` (countable, units and others) the depths of 1, 2 and 5 reads of each power of ten a unit that its reads suffice for: step and fraction."""
    grid = F.array(*[F.lit(m * 10**d).cast("long") for d in range(decades[0], decades[1] + 1) for m in (1, 2, 5)])
    return units.withColumn("step", F.explode(grid)).withColumn("fraction", F.col("step") * F.col("units") / F.col("countable")).where("fraction <= 1")


def pilot_errors(measure: Callable[[list[float]], DataFrame], countable: int, units: float, decades: tuple[int, int] = (2, 6)) -> DataFrame:
    """limit_errors of fits at each depth of the pilot grid, over the same depths and all reads; the last frac_idx is that of all reads.

    `measure` gives the valid and discarded molecules of a list of fractions, in one plan.
    """
    molecules = kept(measure([*pilot_fractions(countable, units, decades), 1.0]).select("seed", "frac_idx", "total", "valid"))
    totals = bulk(molecules)
    return limit_errors(totals, reads_histogram(molecules, BINS), totals)


def rational(counts: np.ndarray, most: float, points: int = 100) -> tuple[int, np.ndarray]:
    """Degree and coefficients (above, below) of a rational function for the new molecules at t times the reads more.

    The alternating power series of the histogram diverges beyond t = 1; the
    function agrees with its first terms and is taken at the largest degree at
    which the curve up to `most` has no pole, rises and flattens.
    """
    series = counts * (-1.0) ** np.arange(len(counts))
    t = np.linspace(0, most, points + 1)[1:]
    for half in range((len(series) - 1) // 2, 0, -1):
        system = np.asarray([[series[half + i - j - 1] if half + i - j - 1 >= 0 else 0.0 for j in range(half)] for i in range(half)])
        try:
            below = np.r_[1.0, np.linalg.solve(system, -series[half : 2 * half])]
        except np.linalg.LinAlgError:
            continue
        above = np.asarray([sum(series[i - j] * below[j] for j in range(i + 1)) for i in range(half)])
        down = np.polyval(below[::-1], t)
        new = np.r_[0.0, t * np.polyval(above[::-1], t) / np.where(down == 0, np.nan, down)]
        rise = np.diff(new)
        if (down > 0).all() and np.isfinite(new).all() and (rise >= 0).all() and (np.diff(rise) <= 1e-9 * abs(new).max()).all():
            return half, np.stack([np.r_[above, 0.0], below])
    return 0, np.asarray([[0.0], [1.0]])


def extrapolate(histograms: DataFrame, *keys: str, most: float = 10.0, points: int = 20) -> DataFrame:
    """keys, times (of the reads), molecules and degree: curves beyond the reads at hand, from each group's histogram (bin, n).

    Degree 0 marks a group without a stable function; its molecules are null.
    """
    fields = {f.name: f.dataType.simpleString() for f in histograms.schema.fields}

    def extend(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(max(3, int(rows["bin"].max())))
        np.add.at(counts, rows["bin"].to_numpy().astype(int) - 1, rows["n"].to_numpy())
        gap = np.flatnonzero(counts == 0)  # terms beyond the first gap are noise, and the last bin may be a tail
        degree, (above, below) = rational(counts[: max(3, min(gap[0] if len(gap) else 50, 50))], most)
        t = np.linspace(0, most, points + 1)
        seen = counts.sum() + t * np.polyval(above[::-1], t) / np.polyval(below[::-1], t)
        out = pd.DataFrame({"times": 1 + t, "molecules": seen if degree else np.nan, "degree": degree})
        for place, (name, value) in enumerate(zip(keys, key)):
            out.insert(place, name, value)
        return out

    return histograms.where("bin >= 1").groupBy(*keys).applyInPandas(extend, ", ".join(f"{k} {fields[k]}" for k in keys) + ", times double, molecules double, degree int")


def extrapolate_bounds(histograms: DataFrame, *keys: str, most: float = 10.0, points: int = 20, replicates: int = 100, level: float = 0.95, seed: int = 42) -> DataFrame:
    """keys, times, molecules, lower, upper and stable (the share of replicates with a stable function): extrapolate, with bounds by a bootstrap.

    Each replicate draws every bin's number of molecules anew; replicates are
    rows, dealt to tasks like groups. A group without a stable function has null
    molecules, but may have bounds.
    """
    fields = {f.name: f.dataType.simpleString() for f in histograms.schema.fields}

    def redraw(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.groupby("bin", as_index=False)["n"].sum().sort_values("bin")
        # A draw depends on the replicate and the histogram only.
        rng = np.random.default_rng([seed, int(key[-1]), int(rows["n"].sum()), len(rows)])
        out = pd.DataFrame({"bin": rows["bin"].to_numpy(), "n": rng.poisson(rows["n"].to_numpy())})
        for place, (name, value) in enumerate(zip([*keys, "__replicate"], key, strict=True)):
            out.insert(place, name, value)
        return out

    copies = histograms.where("bin >= 1").select(*keys, F.col("bin").cast("long").alias("bin"), F.col("n").cast("long").alias("n")).withColumn("__replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    kind = ", ".join(f"{k} {fields[k]}" for k in keys) + ", __replicate int, bin long, n long"
    drawn = copies.groupBy(*keys, "__replicate").applyInPandas(redraw, kind)
    curves = extrapolate(drawn, *keys, "__replicate", most=most, points=points).withColumn("times", F.round("times", 9))
    tail = (1 - level) / 2
    found = curves.groupBy(*keys, "times").agg(
        F.percentile(F.when(F.col("degree") > 0, F.col("molecules")), F.lit(tail)).alias("lower"), F.percentile(F.when(F.col("degree") > 0, F.col("molecules")), F.lit(1 - tail)).alias("upper"), F.avg((F.col("degree") > 0).cast("double")).alias("stable")
    )
    whole = extrapolate(histograms, *keys, most=most, points=points).withColumn("times", F.round("times", 9))
    return whole.select(*keys, "times", F.when(F.col("degree") > 0, F.col("molecules")).alias("molecules")).join(found, [*keys, "times"])


def least_size(histograms: DataFrame, *keys: str) -> DataFrame:
    """A lower bound of the library: molecules seen, and n1 (n1 - 1) / (2 (n2 + 1)) unseen ones."""
    once, twice = (F.sum(F.when(F.col("bin") == b, F.col("n")).otherwise(0)) for b in (1, 2))
    return histograms.groupBy(*keys).agg((F.sum("n") + once * (once - 1) / (2 * (twice + 1))).alias("least_size"))
