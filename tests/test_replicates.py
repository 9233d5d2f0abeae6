"""Local regression, vectors, communities with refinement, and indices of agreement against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cambium.operators import communities, replicates, stability


def plain_local(x, y, at, span):
    """Each gene by itself: the nearest share of genes, tricube weights, a weighted quadratic."""
    out = []
    for a in at:
        d = np.abs(np.asarray(x) - a)
        width = np.sort(d)[max(3, int(np.floor(span * len(x) + 1e-9))) - 1]
        w = np.where(d <= width, (1 - np.minimum(d / width, 1) ** 3) ** 3, 0)
        c = np.polyfit(np.asarray(x) - a, y, 2, w=np.sqrt(w))
        out.append(c[-1])
    return np.asarray(out)


def test_local_trend():
    draw = np.random.default_rng(1)
    x = draw.uniform(-2, 3, 150)
    y = np.sin(x) + draw.normal(0, 0.1, 150)
    found = stability.local_trend(x, y, np.ones(150), x)
    assert found == pytest.approx(plain_local(x, y, x, 0.3), abs=1e-6)
    # A point that stands for three rows counts like the three.
    three = stability.local_trend(np.r_[x, x[:5]], np.r_[y, y[:5]], np.ones(155), x)
    assert stability.local_trend(x, y, np.r_[np.full(5, 2), np.ones(145)], x) == pytest.approx(three, abs=1e-6)


def test_variable_genes(spark):
    draw = np.random.default_rng(2)
    cells, genes = 60, 120
    mean = 10 ** draw.uniform(-0.5, 2, genes)
    matrix = draw.poisson(mean, (cells, genes))
    odd = int(np.argsort(mean)[100])  # one that varies more, away from the trend's ends
    matrix[:, odd] = draw.negative_binomial(0.5, 0.5 / (0.5 + mean[odd]), cells)
    rows = [(c, g, int(v)) for c in range(cells) for g, v in enumerate(matrix[c]) if v]
    counts = spark.createDataFrame(rows, "barcode long, gene long, value long")
    found = {r["gene"]: r["score"] for r in stability.variable_genes(counts, cells, genes).collect()}
    m, v = matrix.mean(0), matrix.var(0, ddof=1)
    on = v > 0
    sd = np.sqrt(10 ** plain_local(np.log10(m[on]), np.log10(v[on]), np.log10(m[on]), 0.3))
    z = np.minimum((matrix[:, on] - m[on]) / sd, np.sqrt(cells))
    want = dict(zip(np.flatnonzero(on).tolist(), ((z**2).sum(0) / (cells - 1)).tolist()))
    assert found.keys() == want.keys() and all(found[g] == pytest.approx(want[g], rel=1e-5) for g in want)
    assert max(found, key=found.get) == odd


def test_dense_vectors(spark):
    scores = spark.createDataFrame([(1, 5, 2.0, -0.5), (2, 9, 1.0, -0.25), (2, 5, 3.0, -0.5), (3, 7, 1.0, 0.0)], "barcode long, gene long, z double, zero double")
    found = {r["id"]: r["vec"] for r in stability.dense_vectors(scores, [5, 9]).collect()}
    assert found == {1: [2.0, -0.25], 2: [3.0, 1.0]}


def plain_modularity(edges, label, gamma):
    k, twice = {}, 0.0
    for a, b, w in edges:
        k[a], k[b], twice = k.get(a, 0) + w, k.get(b, 0) + w, twice + 2 * w
    inside = sum(2 * w for a, b, w in edges if label[a] == label[b])
    whole = {}
    for i, d in k.items():
        whole[label[i]] = whole.get(label[i], 0) + d
    return inside / twice - gamma * sum(d * d for d in whole.values()) / twice**2


def connected(edges, label):
    near = {}
    for a, b, _ in edges:
        if label[a] == label[b]:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for c in set(label.values()):
        nodes = {i for i, x in label.items() if x == c}
        seen, todo = set(), [min(nodes)]
        while todo:
            i = todo.pop()
            if i not in seen:
                seen.add(i)
                todo += near.get(i, ())
        if seen != nodes:
            return False
    return True


def test_communities_of_several_graphs(spark):
    """Two graphs at two resolutions in the same jobs: communities hang together, and are about as good as those planted."""
    draw = np.random.default_rng(0)
    label = draw.integers(0, 4, 60)
    edges = {"x": [(i, j, 1.0) for i in range(60) for j in range(i) if draw.random() < (0.5 if label[i] == label[j] else 0.03)]}
    edges["y"] = [(i, j, 2.0) for i, j, _ in edges["x"] if (i + j) % 5] + [(0, 0, 1.5), (200, 201, 1.0)]
    table = spark.createDataFrame([(g, *e) for g, of in edges.items() for e in of], "name string, a long, b long, weight double")
    found = {}
    for r in communities.communities_at(table, [0.7, 1.0], "name").collect():
        found.setdefault((r["name"], r["resolution"]), {})[r["id"]] = r["community"]
    assert set(found) == {(g, r) for g in "xy" for r in (0.7, 1.0)}
    for (g, gamma), own in found.items():
        assert connected(edges[g], own) and set(own) == {i for a, b, _ in edges[g] for i in (a, b)}
        assert all(c == min(i for i, x in own.items() if x == c) for c in set(own.values()))
        planted = {i: int(label[i]) if i < 60 else 9 for i in own}
        assert plain_modularity([e for e in edges[g] if e[0] != e[1]], own, gamma) >= plain_modularity([e for e in edges[g] if e[0] != e[1]], planted, gamma) - 0.01


def test_rand_index_by_groups(spark):
    rows = [("p", 1, 1), ("p", 1, 1), ("p", 2, 2), ("p", 2, 2), ("q", 1, 1), ("q", 1, 2), ("q", 2, 1), ("q", 2, 2), ("r", 1, 5)]
    labels = spark.createDataFrame(rows, "g string, x int, y int")
    found = {r["g"]: r["ari"] for r in stability.adjusted_rand_by(labels, ["g"], "x", "y").collect()}
    single = {g: stability.adjusted_rand(labels.where(F.col("g") == g), "x", "y").first()[0] for g in "pq"}
    assert found == {"p": 1.0, "q": pytest.approx(-0.5), "r": 1.0} and {g: found[g] for g in "pq"} == single


def test_overlaps(spark):
    genes = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.0), (2, 2, 0.0), (2, 3, 0.0)], "seed long, gene long, score double")
    near = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (2, 0, 1), (2, 0, 3), (1, 5, 1), (2, 5, 2)], "seed long, id long, other long")
    groups = spark.createDataFrame([(s, 1.0, i, 0) for s in (1, 2, 3) for i in (0, 5)], "seed long, resolution double, id long, community long")
    found = replicates.Replicates(genes, near, groups)
    assert {(r["a"], r["b"]): r["jaccard"] for r in found.gene_overlap().collect()} == {(1, 2): pytest.approx(1 / 3), (1, 3): 0.0, (2, 3): 0.0}
    row = found.neighbour_overlap().first()
    assert (row["mean"], row["median"]) == (pytest.approx(1 / 6), pytest.approx(1 / 6))
    assert {r["clusters"] for r in found.clusters().collect()} == {1} and found.rand().count() == 3
