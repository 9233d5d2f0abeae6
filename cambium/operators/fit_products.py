"""What a fit of a library comes to: a baseline at a target saturation, a curve spaced by saturation, histograms side by side, and costs.

The baseline is fitted where saturation is moderate, at a fraction that two
refits find; the fitted model, inverted, then spaces the fractions of the curve
evenly in saturation, all of which are thinned in one plan. Tables have one row
a fit or a step, and keep what they are made from as columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import library
from ..session import kept
from .curves import curve_fractions, prediction_errors, target_fraction
from .fitting import fit_histograms
from .summaries import bulk, by_class, molecule_class, reads_histogram

CLASSES = ("spliced", "unspliced", "ambiguous")


def steps(first: float, last: float, step: float) -> Column:
    """An array from `first` to `last`, the end included."""
    n = int((last - first) / step + 1e-9)
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.lit(float(first)) + i * float(step))


def saturation_costs(fits: DataFrame, first: float = 10, last: float = 95, step: float = 1) -> DataFrame:
    """For each fit (size, r, rate: countable reads of all reads, and others) and each percent of saturation: reads, molecules, sequenced_reads and recovery."""
    # A fit takes long for its size, so fits are dealt to all cores.
    dealt = fits.repartition(2 * fits.sparkSession.sparkContext.defaultParallelism)
    found = dealt.withColumn("saturation", F.explode(steps(first, last, step))).withColumn("reads", library.reads_for_saturation("saturation", "size", "r"))
    return priced(found).withColumn("recovery", library.recovery(F.col("reads"), F.col("size"), F.col("r")))


def recovery_costs(fits: DataFrame, first: float = 10, last: float = 95, step: float = 1) -> DataFrame:
    """For each fit and each percent of recovery: reads, molecules, sequenced_reads and saturation."""
    found = fits.withColumn("recovery", F.explode(steps(first, last, step))).withColumn("reads", library.reads_for_recovery(F.col("recovery") / 100, F.col("size"), F.col("r")))
    return priced(found).withColumn("saturation", library.saturation(F.col("reads"), library.molecules(F.col("reads"), F.col("size"), F.col("r"))))


def priced(costs: DataFrame) -> DataFrame:
    seen = library.molecules(F.col("reads"), F.col("size"), F.col("r"))
    return costs.withColumn("molecules", F.round(seen).cast("long")).withColumn("sequenced_reads", F.round(F.col("reads") / F.col("rate")).cast("long"))


def sized(fits: DataFrame) -> DataFrame:
    """Adds size, the estimate of the library, to fits with reads; null where a fit failed."""
    return fits.withColumn("size", F.when(~F.col("failed"), library.library_size(F.col("reads"), F.col("r"), F.col("p"))))


def predicted_histogram(fits: DataFrame, bins: int) -> DataFrame:
    """For each fit (r, p, molecules and others) and each number of reads up to `bins`: share and expected molecules."""
    # A fit's shares are found once, not once a bin.
    found = fits.withColumn("__shares", library.reads_pmf("r", "p", bins)).select("*", F.posexplode("__shares").alias("bin", "share")).drop("__shares")
    share = F.when(F.col("r").isNotNull() & F.col("p").isNotNull(), F.col("share"))
    return found.withColumns({"bin": F.col("bin") + 1, "share": share}).withColumn("expected", F.col("share") * F.col("molecules"))


def side_by_side(histograms: dict[str, DataFrame], bins: int) -> DataFrame:
    """bin from 1 to `bins` and a column for each named histogram (bin, n), 0 where it has no molecules."""
    spark = next(iter(histograms.values())).sparkSession
    wide = spark.range(1, bins + 1).select(F.col("id").cast("long").alias("bin"))
    for name, histogram in histograms.items():
        wide = wide.join(F.broadcast(histogram.select(F.col("bin").cast("long").alias("bin"), F.col("n").alias(name))), "bin", "left")  # `bins` rows at most
    return wide.fillna(0).select("bin", *histograms)


def spaced_fractions(fit: DataFrame, countable: int, low: float, high: float, points: int) -> list[float]:
    """Fractions at which the fitted model (one row: size, r) has saturations evenly spaced from `low` to `high`; the last is all reads."""
    gap = (high - low) / max(points - 1, 1)
    rows = fit.withColumn("at", F.explode(F.array(*[F.lit(float(low + i * gap)) for i in range(points)]))).withColumn("reads", library.reads_for_saturation("at", "size", "r"))
    found = sorted(r["reads"] / countable for r in rows.select("reads").collect() if r["reads"])
    return [f for f in found[: points - 1] if f < 1] + [1.0]


@dataclass
class Products:
    #: One row: the fraction, totals, fits of all reads and of each class, errors, and what all reads come to.
    baseline: DataFrame
    #: A row for each point: totals, what the fit predicts and how far off it is.
    curve: DataFrame
    #: bin and molecules of the baseline and of all reads, in total and by class.
    histograms: DataFrame
    saturation_costs: DataFrame
    recovery_costs: DataFrame


def products(measure: Callable[[list[float]], DataFrame], countable: int, total: int, target: float = 50.0, most: float = 55.0, points: int = 8, max_hist: int = 50, first: float = 10, last: float = 95, step: float = 1, classes: bool = True) -> Products | None:
    """All products of a library; `measure` gives the valid and discarded molecules of a list of fractions, in one plan. None if there is nothing to fit.

    Classes are left out for libraries that have none. A curve whose saturation
    stays below `first` has the point of all reads only. A fit that fails keeps
    its row; its curve is spaced evenly, without predictions, and it has no costs.
    """
    needed = ("seed", "frac_idx", "total", "valid", *CLASSES)
    fraction = target_fraction(lambda f: measure([f]), countable, target, most)
    at = kept(measure([fraction]).select(*needed))
    fits = kept(sized(fit_histograms(reads_histogram(at, max_hist), "seed", "frac_idx", bins=max_hist - 1).join(bulk(at), ["seed", "frac_idx"])).withColumn("rate", F.lit(countable / total if total else 1.0)))
    row = fits.first()
    if row is None:
        return None
    whole = kept(measure([1.0]).select(*needed))
    full = bulk(whole).first()
    if row["size"] is None:
        fractions = curve_fractions(points)
    else:
        fractions = spaced_fractions(fits, countable, first, full["saturation"], points) if full["saturation"] > first else [1.0]
    curve = kept(measure(fractions).select(*needed))
    numbers = fits.sparkSession.createDataFrame(list(enumerate(fractions)), "frac_idx int, fraction double")
    known = fits.select("seed", "size", "r")
    totals = bulk(curve).join(F.broadcast(numbers), "frac_idx").withColumnsRenamed({"molecules": "seen", "saturation": "seen_saturation"})
    errors = kept(prediction_errors(totals.join(F.broadcast(known), "seed")).withColumn("downsampled_frac", (F.col("reads") + F.col("reads_discarded")) / countable))
    mae = errors.agg(F.avg("saturation_err").alias("saturation_mae"))  # one row
    ends = {"fraction": fraction, "countable_reads": countable, "total_reads": total, "full_saturation": full["saturation"], "full_reads": full["reads"], "full_molecules": full["molecules"]}
    baseline = fits.withColumns({k: F.lit(v) for k, v in ends.items()}).withColumn("recovery", library.recovery(F.col("reads"), F.col("size"), F.col("r"))).crossJoin(F.broadcast(mae))
    shapes = {"total": reads_histogram(at, max_hist), "full_total": reads_histogram(whole, max_hist)}
    if classes:
        named = lambda df: df.withColumn("class", molecule_class())
        by = kept(reads_histogram(named(at), max_hist, "class"))
        own = sized(fit_histograms(by, "seed", "class", bins=max_hist - 1).join(by_class(at).drop("frac_idx"), ["seed", "class"]))
        wide = own.groupBy("seed").pivot("class", list(CLASSES)).agg(*[F.first(c).alias(c) for c in ("reads", "molecules", "r", "p", "ks", "nll_per_molecule", "tail_mass", "failed", "size")])
        baseline = baseline.join(F.broadcast(wide), "seed", "left")  # one row a seed
        full_by = reads_histogram(named(whole), max_hist, "class")
        for name in CLASSES:
            shapes |= {name: by.where(F.col("class") == name), f"full_{name}": full_by.where(F.col("class") == name)}
    sure = fits.where("size IS NOT NULL").select("size", "r", "rate")
    return Products(kept(baseline), errors.drop("frac_idx"), side_by_side(shapes, max_hist), saturation_costs(sure, first, last, step), recovery_costs(sure, first, last, step))


def saved_baseline(spark: SparkSession, prefix: str) -> tuple[DataFrame, DataFrame]:
    """The baseline that the fit command wrote under a prefix, and the points of its curve that have all reads."""
    return spark.read.parquet(f"{prefix}_fit_baseline.parquet"), spark.read.parquet(f"{prefix}_fit_curve.parquet").where("fraction >= 1")
