"""Empty droplets: smoothing, alpha, the knee and the draws, each against a plain version."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cambium.operators import droplets


def plain_good_turing(values):
    """Simple Good-Turing by its description: raw estimates while they differ from the smooth ones, the smooth ones from there on."""
    counts = sorted(set(values))
    n = {c: values.count(c) for c in counts}
    total = sum(values)
    z = {}
    for i, c in enumerate(counts):
        before = counts[i - 1] if i else 0
        after = counts[i + 1] if i + 1 < len(counts) else 2 * c - before
        z[c] = 2 * n[c] / (after - before)
    b, _ = np.polyfit(np.log(counts), np.log([z[c] for c in counts]), 1)
    star, smooth_now = {}, False
    for c in counts:
        smooth = c * (1 + 1 / c) ** (b + 1)
        if c + 1 not in n:
            smooth_now = True
        if not smooth_now:
            raw = (c + 1) * n[c + 1] / n[c]
            if abs(raw - smooth) <= 1.96 * math.sqrt((c + 1) ** 2 * n[c + 1] / n[c] ** 2 * (1 + n[c + 1] / n[c])):
                smooth_now = True
        star[c] = smooth if smooth_now else raw
    unseen = n.get(1, 0) / total
    whole = sum(n[c] * star[c] for c in counts)
    return {c: (1 - unseen) * star[c] / whole for c in counts}, unseen


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_good_turing(seed):
    draw = np.random.default_rng(seed)
    values = [int(v) for v in draw.negative_binomial(0.4, 0.05, 900) if v]
    want, unseen = plain_good_turing(values)
    counts = np.asarray(sorted(set(values)))
    n = np.asarray([values.count(c) for c in counts])
    together, found = droplets.good_turing(counts, n)
    assert found == pytest.approx(unseen) and together.sum() + found == pytest.approx(1)
    assert together / n == pytest.approx([want[c] for c in counts])


@pytest.mark.parametrize("alpha", [float("inf"), 3.0])
def test_draws_have_the_distribution(alpha):
    """Of two genes the share of each outcome is its probability, and the log probability is that of the outcome."""
    shares, n = np.asarray([0.1, 0.3]), np.asarray([1, 3])
    p = [0.1, 0.3, 0.3, 0.3]
    found = {}
    for i in range(20_000):
        value = round(float(droplets.drawn(shares, n, 2, alpha, np.random.default_rng([9, i]))[1]), 6)
        found[value] = found.get(value, 0) + 1

    def chance(a, b):
        if math.isinf(alpha):
            return p[a] * p[b]
        return p[a] * (alpha * p[b] + (a == b)) / (alpha + 1)

    want = {}
    for a in range(4):
        for b in range(a, 4):
            q = chance(a, b) * (1 if a == b else 2)
            key = round(math.log(q), 6)
            want[key] = want.get(key, 0) + q
    assert set(found) == set(want)
    assert all(abs(found[k] / 20_000 - want[k]) < 0.015 for k in want)


def simulated(draw, alpha, genes=60, ambient=150, size=60):
    p = draw.dirichlet(np.full(genes, 0.7))
    rows = []
    for b in range(ambient):
        own = draw.dirichlet(alpha * p) if not math.isinf(alpha) else p
        rows += [(b, g, int(n)) for g, n in enumerate(draw.multinomial(size, own)) if n]
    return p, rows


def test_alpha(spark):
    """The estimate is the likeliest of a fine grid, and near the truth."""
    p, rows = simulated(np.random.default_rng(2), 40.0)
    counts = spark.createDataFrame(rows, "barcode long, gene long, value long")
    totals = counts.groupBy("barcode").agg(F.sum("value").alias("total"))
    profile = spark.createDataFrame(list(enumerate(p.tolist())), "gene long, share double")
    found = droplets.alpha_of(counts, profile, totals, 100)

    def score(a):
        own = sum(math.lgamma(n + a * p[g]) - math.lgamma(a * p[g]) for _, g, n in rows)
        return own + 150 * (math.lgamma(a) - math.lgamma(60 + a))

    best = max(np.exp(np.linspace(math.log(5), math.log(500), 4001)), key=score)
    assert found == pytest.approx(best, rel=0.01) and 25 < found < 65


def test_likelihood(spark):
    rows = [(1, 0, 3), (1, 1, 30), (2, 1, 1)]
    counts, p, a = spark.createDataFrame(rows, "barcode long, gene long, value long"), [0.2, 0.8], 7.5
    totals = counts.groupBy("barcode").agg(F.sum("value").alias("total"))
    profile = spark.createDataFrame(list(enumerate(p)), "gene long, share double")
    found = {r["barcode"]: r["observed"] for r in droplets.likelihoods(counts, profile, totals, a).collect()}
    for barcode, total in ((1, 33), (2, 1)):
        own = [(p[g], n) for b, g, n in rows if b == barcode]
        want = math.lgamma(total + 1) + math.lgamma(a) - math.lgamma(total + a) + sum(math.lgamma(n + a * q) - math.lgamma(a * q) - math.lgamma(n + 1) for q, n in own)
        assert found[barcode] == pytest.approx(want, abs=1e-6)


def test_knee(spark):
    sizes = [10_000 - 20 * i for i in range(300)] + [int(3000 / (1 + i / 10) ** 2) + 101 for i in range(3000)]
    totals = spark.createDataFrame([(s,) for s in sizes], "total long")
    found = droplets.knee(totals, 100)
    assert 2000 <= found <= 5000
    assert droplets.knee(totals.where("total = 10000"), 100) is None and droplets.knee(totals, 10**6) is None


def test_calls(spark):
    """Overdispersed ambient droplets aren't cells, droplets of another profile are; samples by themselves, whatever the partitions."""
    draw = np.random.default_rng(8)
    p, rows = simulated(draw, 60.0)
    other = draw.dirichlet(np.full(60, 0.3))
    for b in range(200, 230):
        rows += [(b, g, int(n)) for g, n in enumerate(draw.multinomial(250, draw.dirichlet(60.0 * p))) if n]
    for b in range(300, 330):
        rows += [(b, g, int(n)) for g, n in enumerate(draw.multinomial(250, 0.5 * p + 0.5 * other)) if n]
    rows += [(400 + i, g, 40) for i in range(3) for g in range(60)]
    counts = spark.createDataFrame(rows, "barcode long, gene long, value long")
    found = {r["barcode"]: r for r in droplets.droplet_calls(counts, 100, 2000, 1000).collect()}
    assert set(found) == {*range(200, 230), *range(300, 330), 400, 401, 402}
    assert all(found[b]["p"] == 0 and found[b]["is_cell"] for b in range(400, 403))
    assert sum(found[b]["is_cell"] for b in range(200, 230)) <= 2 and sum(found[b]["is_cell"] for b in range(300, 330)) >= 25
    strict = droplets.droplet_calls(counts, 100, 2000, 1000, alpha=float("inf")).where("barcode < 230").agg(F.sum("is_cell")).first()[0]
    assert strict > 10  # multinomial draws take overdispersion for cells
    both = counts.withColumn("sample", F.lit("a")).unionByName(counts.withColumn("sample", F.lit("b"))).repartition(5)
    by = {(r["sample"], r["barcode"]): (r["p"], r["is_cell"]) for r in droplets.calls_by(both, "sample", lower=100, retain=2000, iterations=1000).collect()}
    assert by == {(s, b): (r["p"], r["is_cell"]) for s in "ab" for b, r in found.items()}
    assert droplets.droplet_calls(counts.where("false")).count() == 0
