"""The negative binomial library model: molecules seen after R reads of a library of L molecules with dispersion r."""

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def molecules(reads: Column, size: Column, r: Column) -> Column:
    return size * (1 - F.pow(r / (r + reads / size), r))


def saturation(reads: Column, mols: Column) -> Column:
    return 100 - 100 * mols / reads


def recovery(reads: Column, size: Column, r: Column) -> Column:
    return 100 * (1 - F.pow(size * r / (reads + size * r), r))


def reads_for_recovery(share: Column, size: Column, r: Column) -> Column:
    """Reads that recover a share, below 1, of the library."""
    return r * size * (F.pow(1 - share, -1 / r) - 1)


def library_size(reads: Column, r: Column, p: Column) -> Column:
    return reads * p / (r * (1 - p))


def log1mexp(a: Column) -> Column:
    """log(1 - exp(a)) for a below 0, without loss near 0."""
    return F.when(a > -0.6931471805599453, F.log(-F.expm1(a))).otherwise(F.log1p(-F.exp(a)))


def inverted(percent: np.ndarray, size: np.ndarray, r: np.ndarray, steps: int) -> np.ndarray:
    """Reads at which saturation reaches `percent`: doubling from above, then bisection until nothing changes."""
    share = (100 - percent) / 100
    seen = lambda x: size * (1 - (r / (r + x / size)) ** r)
    low, high = np.zeros(len(size)), np.maximum(size, 10.0)
    for _ in range(100):
        if not (short := seen(high) > share * high).any():
            break
        high = np.where(short, high * 2, high)
    for _ in range(steps):
        middle = (low + high) / 2
        more = seen(middle) > share * middle
        after = np.where(more, middle, low), np.where(more, high, middle)
        if np.array_equal(after[0], low) and np.array_equal(after[1], high):
            break
        low, high = after
    return (low + high) / 2


def reads_for_saturation(percent: str, size: str, r: str, steps: int = 100) -> Column:
    """Reads at which saturation reaches `percent`, a batch of rows at once; names of columns. Null where one of them is."""

    @F.pandas_udf("double")
    def needed(percent: pd.Series, size: pd.Series, r: pd.Series) -> pd.Series:
        given = [x.to_numpy(dtype=float) for x in (percent, size, r)]
        found, sure = np.full(len(percent), np.nan), ~np.isnan(given).any(0)
        with np.errstate(all="ignore"):
            found[sure] = inverted(*(x[sure] for x in given), steps)
        return pd.Series(found).astype("Float64").mask(~sure)

    return needed(*[F.col(c).cast("double") for c in (percent, size, r)])


def reads_pmf(r: str, p: str, bins: int) -> Column:
    """Shares of molecules with 1, 2 ... reads among those of 1 ... bins, all in one array; names of columns. Terms follow one another, so no gamma function is needed."""
    k = np.arange(1, bins + 1)

    @F.pandas_udf("array<double>")
    def shares(r: pd.Series, p: pd.Series) -> pd.Series:
        r, p = (x.to_numpy(dtype=float)[:, None] for x in (r, p))
        terms = np.cumprod((r + k - 1) / k * (1 - p), axis=1)
        return pd.Series(list(terms / terms.sum(1, keepdims=True)))

    return shares(*[F.col(c).cast("double") for c in (r, p)])


def predictions(reads: str, size: str, r: str) -> dict[str, Column]:
    """molecules, saturation and recovery that the model predicts at `reads`; names of columns."""
    seen = molecules(F.col(reads), F.col(size), F.col(r))
    return {"molecules": seen, "saturation": saturation(F.col(reads), seen), "recovery": recovery(F.col(reads), F.col(size), F.col(r))}
