"""Zero-truncated negative binomial fits of reads-per-molecule histograms, one for each group of a table."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

R_BOUNDS, MU_BOUNDS = (0.25, 50.0), (1e-6, 200.0)
FIT = "r double, p double, nll_per_molecule double, ks double, failed boolean, tail_mass double"


def log_pmf(r: float, mu: float, top: int) -> np.ndarray:
    """Of 1 ... top reads, given at least one."""
    k = np.arange(1, top + 1)
    p = mu / (r + mu)
    logs = np.cumsum(np.log(r + k - 1) - np.log(k)) + r * np.log1p(-p) + k * np.log(p)
    return logs - np.log(-np.expm1(r * np.log1p(-p)))


def minimise(f, x: np.ndarray, step: float = 0.5, rounds: int = 400) -> tuple[np.ndarray, float]:
    """The simplex method of Nelder and Mead over two variables."""
    simplex = sorted(((f(q), tuple(q)) for q in (x, x + [step, 0], x + [0, step])))
    for _ in range(rounds):
        (low, best), (middle, second), (high, worst) = simplex
        if high - low <= 1e-14 * (1 + abs(low)) and np.ptp([best, second, worst], axis=0).max() < 1e-8:
            break
        centre, worst = (np.add(best, second)) / 2, np.asarray(worst)

        def at(t: float, centre=centre, worst=worst) -> tuple[float, tuple]:
            q = centre + t * (centre - worst)
            return f(q), tuple(q)

        new = at(1.0)
        if new[0] < low:
            new = min(new, at(2.0))
        elif new[0] >= middle:
            new = min(at(0.5), at(-0.5))
        if new[0] < high:
            simplex[2] = new
        else:
            simplex[1:] = [(f(q), tuple(q)) for q in ((np.add(best, other)) / 2 for other in (second, worst))]
        simplex.sort()
    return np.asarray(simplex[0][1]), simplex[0][0]


def fit_histogram(counts: np.ndarray) -> tuple[float, float, float, float, bool]:
    """r, p, negative log likelihood a molecule, Kolmogorov-Smirnov distance and whether the fit lies at its bounds. counts[i] molecules have i + 1 reads."""
    n = counts.sum()
    if n == 0:
        return float("nan"), float("nan"), float("nan"), float("nan"), True
    (r0, r1), (m0, m1) = np.log(R_BOUNDS), np.log(MU_BOUNDS)

    def cost(q: np.ndarray) -> float:
        r, mu = np.exp(np.clip(q, (r0, m0), (r1, m1)))
        return float(-(counts * log_pmf(r, mu, len(counts))).sum() / n)

    mean = float((counts * np.arange(1, len(counts) + 1)).sum() / n)
    q, value = min((minimise(cost, np.log([r, max(1e-3, mean * m)])) for r in (0.5, 2.0, 10.0) for m in (0.3, 1.0)), key=lambda found: found[1])
    r, mu = np.exp(np.clip(q, (r0, m0), (r1, m1)))
    model = np.cumsum(np.exp(log_pmf(r, mu, len(counts))))
    ks = float(np.abs(np.cumsum(counts) / n - model / model[-1]).max())
    return float(r), float(r / (r + mu)), value, ks, bool(r > 49)


def tail_mass(r: float, p: float, top: int) -> float:
    """The share of seen molecules that the model has with more than `top` reads."""
    return max(0.0, float(1 - np.exp(log_pmf(r, r * (1 - p) / p, top)).sum()))


def fit_histograms(histograms: DataFrame, *keys: str, bins: int = 49) -> DataFrame:
    """FIT for each group of `keys`; rows are (keys, bin, n). Bins above `bins`, the tail, aren't fitted."""
    fields = {f.name: f.dataType.simpleString() for f in histograms.schema.fields}

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(bins)
        inside = rows[(rows["bin"] >= 1) & (rows["bin"] <= bins)]
        np.add.at(counts, inside["bin"].to_numpy().astype(int) - 1, inside["n"].to_numpy())
        found = fit_histogram(counts)
        return pd.DataFrame([[*key, *found, tail_mass(*found[:2], bins)]], columns=[*keys, "r", "p", "nll_per_molecule", "ks", "failed", "tail_mass"])

    return histograms.groupBy(*keys).applyInPandas(fit, ", ".join(f"{k} {fields[k]}" for k in keys) + ", " + FIT)
