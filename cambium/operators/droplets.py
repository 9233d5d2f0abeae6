"""Cells against empty droplets: how probable a barcode's counts are as a draw from the ambient profile.

The profile is that of the barcodes with few molecules, smoothed by simple
Good-Turing, so genes that none of them has get their part. Draws vary between
droplets: counts are Dirichlet-multinomial, with alpha by maximum likelihood
over the ambient barcodes. A barcode is held against Monte-Carlo draws of its
size, and barcodes above the knee of the curve of sizes are cells without one.

Genes of the same ambient count have the same share, so what tasks are sent is
one row for each distinct count: n distinct counts make n^2 / 2 molecules or
more, which bounds them. Draws of an iteration grow molecule by molecule and
serve barcodes of all sizes; blocks of barcodes and of iterations are dealt to
tasks, which return numbers and keep no draws.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import kept
from .cells import benjamini_hochberg

#: Barcodes of a block, about.
BLOCK = 100_000
#: Where alpha is looked for, and into how many steps the interval is divided in each of ROUNDS.
ALPHAS, STEPS, ROUNDS = (1e-2, 1e4), 16, 4
#: The largest barcodes, among which no knee is looked for.
EXCLUDED = 50


def log_factorial(n: str) -> Column:
    """log(n!): by the factorial up to 20, by Stirling's series above."""
    x = F.col(n).cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * np.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(F.col(n) <= 20, F.log(F.factorial(F.col(n).cast("int")))).otherwise(series)


def good_turing(counts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares of all genes together that have these counts (distinct, from the smallest, n genes each), by simple Good-Turing, and that of unseen genes."""
    total = float((counts * n).sum())
    unseen = n[0] / total if counts[0] == 1 else 0.0
    # All or none seen once: a share that neither is nor leaves nothing.
    unseen = min(max(unseen, 1 / (total + 1)), total / (total + 1))
    star = counts.astype(float)
    if len(counts) > 1:
        before, after = np.r_[0, counts[:-1]], np.r_[counts[1:], 2 * counts[-1] - counts[-2]]
        slope = np.polyfit(np.log(counts), np.log(2 * n / (after - before)), 1)[0]
        smooth = counts * (1 + 1 / counts) ** (slope + 1)
        follows = np.r_[counts[1:] == counts[:-1] + 1, False]
        more = np.r_[n[1:], 1].astype(float)
        raw = (counts + 1) * more / n
        spread = 1.96 * np.sqrt((counts + 1.0) ** 2 * more / n**2 * (1 + more / n))
        alike = np.flatnonzero(~follows | (np.abs(raw - smooth) <= spread))
        star = np.where(np.arange(len(counts)) < alike[0], raw, smooth)
    return (1 - unseen) * n * star / (n * star).sum(), unseen


def ambient_profile(counts: DataFrame, totals: DataFrame, lower: int) -> tuple[DataFrame, np.ndarray]:
    """gene and share, and the distinct shares with their numbers of genes (rows of share, n; from the rarest genes).

    Shares are Good-Turing proportions among barcodes of at most `lower`
    molecules; genes that none of these has divide what is left for unseen ones.
    Without any such molecules, all genes have the same share.
    """
    low = totals.where(F.col("total") <= lower).select("barcode")
    ambient = counts.join(low, "barcode", "left_semi").groupBy("gene").agg(F.sum("value").alias("s"))
    genes = kept(counts.select("gene").distinct().join(ambient, "gene", "left").select("gene", F.coalesce("s", F.lit(0)).alias("s")))
    table = sorted((r["s"], r["n"]) for r in genes.groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect())  # distinct counts
    s, n = np.asarray(table, np.int64).reshape(-1, 2).T
    if not len(s) or s[-1] == 0:
        shares = np.full(len(s), 1 / max(n.sum(), 1))
    else:
        seen = s > 0
        together, unseen = good_turing(s[seen], n[seen])
        shares = np.empty(len(s))
        shares[seen] = together / n[seen] / (1 if (~seen).any() else 1 - unseen)
        shares[~seen] = unseen / n[~seen]
    known = counts.sparkSession.createDataFrame(list(zip(s.tolist(), shares.tolist(), strict=True)), "s long, share double")
    return genes.join(F.broadcast(known), "s").select("gene", "share"), np.stack([shares, n], 1)


def alpha_of(counts: DataFrame, profile: DataFrame, totals: DataFrame, lower: int) -> float:
    """The alpha, within ALPHAS, at which the ambient barcodes' counts are likeliest.

    log of rising factorials are sums over places: a gene's place j counts once
    for each barcode with more than j of it. Places are counted once, and all
    steps of a round are sums over them in one job.
    """
    low = totals.where((F.col("total") <= lower) & (F.col("total") > 0))
    place = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j")
    cells = counts.join(low.select("barcode"), "barcode", "left_semi").select("gene", F.col("value").cast("long").alias("n"))
    by_gene = cells.groupBy("gene", "n").agg(F.count(F.lit(1)).alias("m")).select("gene", "m", place).groupBy("gene", "j").agg(F.sum("m").alias("m"))
    by_gene = by_gene.join(profile, "gene").groupBy("share", "j").agg(F.sum("m").alias("m"))
    whole = low.select(F.col("total").cast("long").alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("m")).select("m", place).groupBy("j").agg((-F.sum("m")).alias("m"))
    places = kept(by_gene.unionByName(whole.withColumn("share", F.lit(1.0))))
    low_end, high_end = np.log(ALPHAS)
    for _ in range(ROUNDS):
        grid = np.exp(np.linspace(low_end, high_end, STEPS + 1))
        found = places.agg(*[F.sum(F.col("m") * F.log(F.lit(float(a)) * F.col("share") + F.col("j"))).alias(f"a{i}") for i, a in enumerate(grid)]).first()
        if found[0] is None:
            return float("inf")
        best = int(np.argmax(found))
        low_end, high_end = np.log(grid[max(best - 1, 0)]), np.log(grid[min(best + 1, STEPS)])
    return float(grid[best])


def knee(totals: DataFrame, lower: int, excluded: int = EXCLUDED) -> int | None:
    """The total at which the curve of totals over ranks (both logarithmic, above `lower`) is furthest above the line between its ends; None if it has no such point."""
    curve = totals.where(F.col("total") > lower).groupBy("total").agg(F.count(F.lit(1)).alias("n")).toArrow()  # distinct totals
    size, n = (curve[c].to_numpy().astype(float) for c in ("total", "n"))
    order = np.argsort(-size)
    size, n = size[order], n[order]
    x, y = np.log10(np.cumsum(n) - (n - 1) / 2), np.log10(size)
    if (x > np.log10(excluded)).sum() >= 3:
        x, y = x[x > np.log10(excluded)], y[x > np.log10(excluded)]
    if len(x) < 3:
        return None
    above = y - (y[0] + (y[-1] - y[0]) * (x - x[0]) / (x[-1] - x[0]))
    return round(10 ** y[above.argmax()]) if above.max() > 1e-9 else None


def likelihoods(counts: DataFrame, profile: DataFrame, totals: DataFrame, alpha: float = float("inf")) -> DataFrame:
    """barcode, total and observed, the log probability of the barcode's counts given its total."""
    if np.isinf(alpha):
        rising, whole = F.col("value") * F.log("share"), F.lit(0.0)
    else:
        a = float(alpha)
        rising = F.expr(f"aggregate(sequence(0L, value - 1), 0D, (__n, __j) -> __n + ln({a!r}D * share + __j))")
        whole = F.expr(f"aggregate(sequence(0L, total - 1), 0D, (__n, __j) -> __n + ln({a!r}D + __j))")
    tested = counts.withColumn("value", F.col("value").cast("long")).join(totals, "barcode").join(profile, "gene")
    sums = tested.groupBy("barcode", "total").agg(F.sum(rising - log_factorial("value")).alias("sum"))
    return sums.select("barcode", "total", (F.col("sum") + log_factorial("total") - whole).alias("observed"))


def drawn(shares: np.ndarray, n: np.ndarray, top: int, alpha: float, rng: np.random.Generator) -> np.ndarray:
    """Log probabilities of the first 1 ... top molecules of one growing draw.

    With a finite alpha, molecule t is of a new draw with chance alpha / (alpha
    + t), else a copy of an earlier one at random, which is the same distribution.
    """
    ends = np.cumsum(shares * n)
    u = rng.random(top) * ends[-1]
    kind = np.minimum(np.searchsorted(ends, u, "right"), len(ends) - 1)
    first = np.cumsum(n) - n
    gene = first[kind] + np.minimum((u - (ends[kind] - shares[kind] * n[kind])) / shares[kind], n[kind] - 1).astype(np.int64)
    t = np.arange(top)
    if not np.isinf(alpha):
        source = np.where(rng.random(top) < alpha / (alpha + t), t, (rng.random(top) * t).astype(np.int64))
        while not np.array_equal(source, further := source[source]):
            source = further
        gene, kind = gene[source], kind[source]
    order = np.argsort(gene, kind="stable")
    turns = np.flatnonzero(np.r_[True, np.diff(gene[order]) != 0])
    before = np.empty(top, np.int64)
    before[order] = np.arange(top) - np.repeat(turns, np.diff(np.r_[turns, top]))
    weight = np.log(shares[kind]) if np.isinf(alpha) else np.log(alpha * shares[kind] + before) - np.log(alpha + t)
    return np.cumsum(np.log(t + 1.0) + weight - np.log(before + 1.0))


def no_more_probable(observed: DataFrame, shares: np.ndarray, alpha: float, iterations: int, seed: int, block: int = BLOCK) -> DataFrame:
    """barcode, total and below: in how many of the iterations a draw of the same total was no more probable."""
    spark = observed.sparkSession
    blocks = max(1, -(-observed.count() // block))
    chunks = max(1, -(-spark.sparkContext.defaultParallelism // blocks))
    share, n = shares[:, 0], shares[:, 1].astype(np.int64)
    kind = observed.schema["barcode"].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if not sum(b.num_rows for b in rows):
            return
        table = pa.Table.from_batches(rows)
        chunk, total, seen = table["chunk"][0].as_py(), table["total"].to_numpy().astype(np.int64), table["observed"].to_numpy()
        # Equal probabilities that were summed in another order still count as equal.
        seen, below = seen + 1e-9 * np.abs(seen), np.zeros(len(seen), np.int64)
        for number in range(chunk, iterations, chunks):
            below += drawn(share, n, int(total.max()), alpha, np.random.default_rng([seed, number]))[total - 1] <= seen
        yield pa.RecordBatch.from_arrays([table["barcode"].combine_chunks(), table["total"].combine_chunks(), pa.array(below)], ["barcode", "total", "below"])

    dealt = observed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    key = F.pmod(F.xxhash64("barcode"), F.lit(blocks)) * chunks + F.col("chunk")
    parts = dealt.repartitionById(blocks * chunks, key.cast("int")).select("barcode", F.col("total").cast("long").alias("total"), "observed", "chunk")
    schema = T.StructType([T.StructField("barcode", kind), T.StructField("total", T.LongType()), T.StructField("below", T.LongType())])
    return parts.mapInArrow(count, schema).groupBy("barcode", "total").agg(F.sum("below").alias("below"))


def droplet_calls(counts: DataFrame, lower: int = 100, retain: int | None = None, iterations: int = 10_000, most_fdr: float = 0.01, seed: int = 42, alpha: float | None = None) -> DataFrame:
    """barcode, total, p, fdr and is_cell of barcodes with more than `lower` molecules.

    `counts` has barcode, gene and value. p is the share of Monte-Carlo draws
    from the ambient profile, as large as the barcode, that are no more probable
    than it, both counted once more. Barcodes of at least `retain` molecules
    (None: the knee; if there is none, no barcode) are cells without a test
    (p = 0). alpha is estimated unless given; infinity means multinomial draws.
    Results depend on `seed`, not on partitions.
    """
    counts = kept(counts.where("value > 0").select("barcode", "gene", "value"))
    totals = kept(counts.groupBy("barcode").agg(F.sum("value").alias("total")))
    profile, shares = ambient_profile(counts, totals, lower)
    profile = kept(profile)
    if retain is None:
        retain = knee(totals, lower)
    if alpha is None:
        alpha = alpha_of(counts, profile, totals, lower)
    above = totals.where(F.col("total") > lower)
    free = F.col("total") >= retain if retain is not None else F.lit(False)
    tested = kept(likelihoods(counts, profile, above.where(~free), alpha))
    below = no_more_probable(tested, shares, alpha, iterations, seed).select("barcode", F.col("total").cast("long").alias("total"), ((F.col("below") + 1) / F.lit(iterations + 1.0)).alias("p"))
    judged = benjamini_hochberg(kept(above.where(free).select("barcode", F.col("total").cast("long").alias("total"), F.lit(0.0).alias("p")).unionByName(below)))
    return judged.select("barcode", "total", "p", "fdr", (F.col("fdr") <= most_fdr).cast("int").alias("is_cell"))


def calls_by(counts: DataFrame, key: str, **options) -> DataFrame:
    """droplet_calls of each value of `key` (a few samples) by itself, with `key` before the columns."""
    counts = kept(counts)
    kind = counts.schema[key].dataType
    found = None
    for value in sorted(r[0] for r in counts.select(key).where(F.col(key).isNotNull()).distinct().collect()):
        one = kept(droplet_calls(counts.where(F.col(key) == F.lit(value)), **options)).select(F.lit(value).cast(kind).alias(key), "barcode", "total", "p", "fdr", "is_cell")
        found = one if found is None else found.unionByName(one)
    return found if found is not None else droplet_calls(counts.where("false"), **options).select(F.lit(None).cast(kind).alias(key), "*")
