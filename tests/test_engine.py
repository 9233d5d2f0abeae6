"""Published values, properties, and text sources."""

import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cambium.engine import Depth
from cambium.functions import library, sequences
from cambium.operators import fit_products, fitting, molecules, stability, summaries, thinning
from cambium.sources import files, libraries

# Molecules by their number of reads in the published example, and what was published of its fit.
HISTOGRAM = [2982943, 1724858, 921897, 442061, 194518, 78520, 29797, 10858, 3740, 1296, 441, 132, 46, 21, 3, 3, 0, 0, 1]
READS, MOLECULES = 12759806, 6391135
R, P, KS, NLL, SIZE = 2.6387012796186737, 0.6690893243860421, 0.004574632917078825, 1.3768456975710197, 9777485.172692884


def test_published_fit():
    assert sum(HISTOGRAM) == MOLECULES
    r, p, nll, ks, failed = fitting.fit_histogram(np.asarray(HISTOGRAM + [0] * (49 - len(HISTOGRAM)), float))
    assert r == pytest.approx(R, rel=1e-4) and p == pytest.approx(P, rel=1e-4)
    assert ks == pytest.approx(KS, abs=1e-6) and nll == pytest.approx(NLL, rel=1e-9) and not failed


def test_published_costs(spark):
    row = spark.range(1).select(
        library.library_size(F.lit(float(READS)), F.lit(R), F.lit(P)).alias("size"),
        library.reads_for_recovery(F.lit(0.1), F.lit(SIZE), F.lit(R)).alias("recovery"),
    ).first()
    assert row["size"] == pytest.approx(SIZE, rel=1e-9) and row["recovery"] == pytest.approx(1051003.9785512895, rel=1e-12)
    asked = spark.createDataFrame([(10.0, SIZE, R), (11.0, SIZE, R)], "s double, size double, r double")
    found = [r[0] for r in asked.orderBy("s").select(library.reads_for_saturation("s", "size", "r")).collect()]
    assert found == pytest.approx([1550929.2146933074, 1722303.2029790478], rel=1e-8)


def test_costs_and_shares_take_a_pass_of_a_batch(spark):
    """Neither is a loop of column expressions over each row, and both agree with plain ones; rows without a fit have none."""
    fits = spark.range(500).select("id", (F.col("id") * 997 % 5000 + 3.0).alias("size"), (0.5 + F.col("id") % 9).alias("r"), (0.3 + F.col("id") % 5 / 10).alias("p"), F.lit(0.5).alias("rate"), F.lit(1000).alias("molecules"))
    fits = fits.unionByName(fits.where("id = 1").withColumns({"id": F.lit(900).cast("long"), "size": F.lit(None).cast("double"), "r": F.lit(None).cast("double")}))
    costs, shares = fit_products.saturation_costs(fits, 10, 95, 5), fit_products.predicted_histogram(fits, 20)
    for found in (costs, shares):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "aggregate(sequence" not in plan and "ArrowEvalPython" in plan
    rows = costs.collect()
    assert len(rows) == 501 * 18
    for row in rows:
        if row["id"] == 900:
            assert row["reads"] is None
            continue
        x, r = row["reads"] / row["size"], row["r"]
        assert 100 - 100 * (1 - (r / (r + x)) ** r) / x == pytest.approx(row["saturation"], abs=1e-7)
    by = {}
    for row in shares.collect():
        by.setdefault(row["id"], {})[row["bin"]] = row["share"]
    assert set(by) == {*range(500), 900} and set(by.pop(900).values()) == {None}
    for key, found in by.items():
        r, p = 0.5 + key % 9, 0.3 + key % 5 / 10
        plain = [math.exp(math.lgamma(k + r) - math.lgamma(k + 1) - math.lgamma(r)) * (1 - p) ** k for k in range(1, 21)]
        assert [found[k] for k in range(1, 21)] == pytest.approx([y / sum(plain) for y in plain], rel=1e-9)


def ancestors(umi, total, length):
    """By search from each tag, best rank first, over tags that none has reached."""
    order = sorted(range(len(umi)), key=lambda i: (-total[i], umi[i]))
    near = lambda x, y: sum((x >> 2 * k & 3) != (y >> 2 * k & 3) for k in range(length)) == 1
    label = {}
    for seed in order:
        if seed in label:
            continue
        label[seed], waiting = seed, [seed]
        while waiting:
            a = waiting.pop()
            for b in order:
                if b not in label and near(umi[a], umi[b]) and total[a] >= 2 * total[b] - 1:
                    label[b] = seed
                    waiting.append(b)
    return [label[i] for i in range(len(umi))]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 255), st.integers(1, 9), min_size=1, max_size=40))
def test_roots_are_those_of_a_search(tags):
    umi, total = np.asarray(list(tags), np.int64), np.asarray(list(tags.values()), np.int64)
    assert molecules.roots(np.zeros(len(umi), np.int64), umi, total, 4).tolist() == ancestors(umi.tolist(), total.tolist(), 4)


def test_thinning(spark):
    tags = spark.range(300).selectExpr("id % 3 AS barcode", "id % 7 AS gene", "id AS umi", "id % 5 + 1 AS spliced", "0L AS unspliced", "id % 2 AS ambiguous")
    fracs = [0.2, 0.5, 1.0]
    for exact in (True, False):
        rows = thinning.thin(tags, fracs, exact=exact).collect()
        by = {(r["frac_idx"], r["umi"]): r["spliced"] + r["ambiguous"] for r in rows}
        whole = {r["umi"]: r["spliced"] + r["ambiguous"] for r in tags.collect()}
        n = sum(whole.values())
        assert {u: k for (f, u), k in by.items() if f == 2} == whole
        assert all(by.get((0, u), 0) <= by.get((1, u), 0) <= k for u, k in whole.items())
        for i, f in enumerate(fracs):
            kept = sum(k for (j, _), k in by.items() if j == i)
            assert abs(kept - n * f) <= 5 * (n * f * (1 - f)) ** 0.5
    assert thinning.thin(tags.where("false"), fracs).count() == 0


def test_molecules_add_up(spark):
    tags = spark.range(2000).selectExpr("id % 4 AS barcode", "id * 31 % 9 AS gene", "id * 37 % 1024 AS umi", "id % 3 AS spliced", "id % 2 AS unspliced", "1L AS ambiguous")
    tags = tags.groupBy("barcode", "gene", "umi").agg(*[F.sum(c).alias(c) for c in thinning.CLASSES])
    found = molecules.mark_multi_gene(molecules.directional(thinning.thin(tags, [0.5, 1.0]), 5)).cache()
    bulk = {r["frac_idx"]: r for r in summaries.bulk(found).collect()}
    reads = {r["frac_idx"]: r["n"] for r in thinning.thin(tags, [0.5, 1.0]).groupBy("frac_idx").agg(F.sum(F.expr("spliced + unspliced + ambiguous")).alias("n")).collect()}
    for i, row in bulk.items():
        assert row["reads"] + row["reads_discarded"] == reads[i] and row["molecules"] <= row["reads"]
    sums = lambda df, c: {r["frac_idx"]: r["n"] for r in df.groupBy("frac_idx").agg(F.sum(c).alias("n")).collect()}
    want = {i: r["molecules"] for i, r in bulk.items()}
    assert sums(summaries.reads_histogram(found, 50), "n") == want
    assert sums(summaries.barcode_stats(found), "molecules") == want
    assert sums(summaries.total_matrix(found), "value") == want and sums(summaries.class_matrices(found), "value") == want


def test_sequences(spark):
    rows = spark.createDataFrame([("ACGT",), ("acgt",), ("ACNT",), ("",), (None,)], "s string")
    code = sequences.encode(F.col("s"))
    assert [tuple(r) for r in rows.select(code, sequences.decode(code, 4)).collect()] == [(27, "ACGT"), (27, "ACGT"), (None, None), (None, None), (None, None)]


def test_agreement_of_equal_labels(spark):
    rows = spark.createDataFrame([(i % 3, i % 3 + 5, i % 2) for i in range(30)], "a int, b int, c int")
    assert stability.adjusted_rand(rows, "a", "b").first()[0] == 1.0
    assert stability.adjusted_rand(rows, "a", "c").first()[0] == pytest.approx(stability.adjusted_rand(rows, "c", "a").first()[0])


def test_annotation_and_alignment_text(spark, tmp_path):
    gtf = tmp_path / "a.gtf"
    gtf.write_text('#x\n1\ts\tgene\t11\t20\t.\t+\t.\tgene_id "G1"; gene_name "N";\n\n1\ts\ttranscript\t11\t20\t.\t+\t.\tgene_id "G1";\n1\ts\texon\t11\t15\t.\t+\t.\tgene_id "G1"; transcript_id "T";\n')
    found = files.read_gtf(spark, str(gtf)).orderBy("feature").collect()
    assert [(r["feature"], r["lft"], r["rgt"], r["gene_id"], r["gene_name"], r["transcript_id"]) for r in found] == [("exon", 10, 14, "G1", "G1", "T"), ("gene", 10, 19, "G1", "N", None)]
    gtf.write_text("1\ts\tgene\t11\t20\t.\t+\t.\tgene_name N;\n")
    with pytest.raises(Exception, match="gene_id"):
        files.read_gtf(spark, str(gtf)).collect()
    sam = tmp_path / "a.sam"
    sam.write_text("@HD\tVN:1\nq1\t16\tchr1\t100\t255\t5M\t*\t0\t0\tA\tI\tCB:Z:AC-1\tUR:Z:ACGT\nq2\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\n")
    rows = files.read_sam(spark, str(sam)).orderBy("qname").collect()
    assert [(r["chrom"], r["pos"], r["cb"], r["umi"], r["gx"]) for r in rows] == [("chr1", 99, "AC-1", "ACGT", None), (None, -1, None, None, None)]


def test_small_text_sources(spark, tmp_path):
    (tmp_path / "genes.txt").write_text("# c\nG1\n\n G2 \nG1\n")
    assert {r[0] for r in files.read_gene_list(spark, str(tmp_path / "genes.txt")).collect()} == {"G1", "G2"}
    (tmp_path / "curve.txt").write_text("TOTAL_READS EXPECTED\n# x\n0 0\n200 150.5\n100 90\n200 150.5\nbad\n")
    assert sorted(map(tuple, files.read_extrapolation(spark, str(tmp_path / "curve.txt")).collect())) == [(100.0, 90.0), (200.0, 150.5)]
    summary = spark.createDataFrame([("a", "reads", "12"), ("b", "param", "1.5"), ("c", "library", "x")], files.SUMMARY)
    assert [(r["whole"], r["number"]) for r in files.summary_values(summary).orderBy("key").collect()] == [(12, 12.0), (None, 1.5), (None, None)]
    index = spark.createDataFrame([("AC-1", 0, 5, 4, 3, 0, 9, None, 1, 3)], files.BARCODE_INDEX)
    files.write_tsv(index, str(tmp_path / "index"))
    assert files.read_barcode_index(spark, str(tmp_path / "index")).collect() == index.collect()


def test_custom_libraries(spark, tmp_path):
    assert libraries.catalogue(spark).count() == 12
    spec = dict(zip(libraries.FIELDS, libraries.BUILT_IN["10X_3p_v3"], strict=True))
    path = tmp_path / "lib.json"
    path.write_text(json.dumps({"mine": spec}))
    assert "mine" in libraries.custom(str(path))
    for wrong in ({"10X_3p_v3": spec}, {"mine": spec | {"random_hex_re": "("}}, {"mine": spec | {"UR_length": 17}}, {"mine": {}}):
        path.write_text(json.dumps(wrong))
        with pytest.raises(libraries.LibraryError):
            libraries.custom(str(path))


def test_excluded_reads_and_fractions(spark):
    tags = spark.range(400).selectExpr("id % 4 AS barcode", "id % 9 AS gene", "id AS umi", "id % 3 AS spliced", "id % 2 AS unspliced", "1L AS ambiguous")
    out = spark.createDataFrame([(1,), (1,), (7,)], "gene long")
    rows = Depth(tags, 5, out).downsample([0.5, 1.0, 1.5], umi_mode="none").bulk().orderBy("frac_idx").collect()
    reads = lambda df: df.agg(F.sum(F.expr("spliced + unspliced + ambiguous"))).first()[0]
    assert len(rows) == 2 and rows[1]["reads_excluded"] == reads(tags.where("gene IN (1, 7)"))
    assert rows[1]["reads"] + rows[1]["reads_discarded"] == reads(tags.where("gene NOT IN (1, 7)"))
    assert 0 < rows[0]["reads_excluded"] < rows[1]["reads_excluded"]
    with pytest.raises(ValueError):
        Depth(tags, 5).downsample([2.0])
    with pytest.raises(ValueError):
        Depth(tags, 5).downsample([0.0, 1.0])


def test_multi_gene_keeps_the_only_largest(spark):
    rows = [(1, g, 7, n) for g, n in ((0, 3), (1, 5), (2, 4))] + [(1, g, 8, n) for g, n in ((0, 5), (1, 5), (2, 1))] + [(1, 0, 9, 1)]
    table = spark.createDataFrame(rows, "barcode long, gene long, umi long, spliced long").selectExpr("1L AS seed", "0 AS frac_idx", "*", "0L AS unspliced", "0L AS ambiguous")
    found = molecules.mark_multi_gene(table)
    assert sorted((r["umi"], r["gene"]) for r in found.where("valid").collect()) == [(7, 1), (9, 0)] and found.count() == len(rows)


def test_grid_places(spark):
    rows = spark.createDataFrame([("s_002um_00320_02575-1",), ("ACGT-1",), (None,)], "s string")
    assert [tuple(r[0]) for r in rows.select(sequences.grid_place(F.col("s"))).collect()] == [(320, 2575), (None, None), (None, None)]


def test_costs_as_published(spark):
    """Rows of the published cost tables of one sample, from its published fit."""
    from cambium.operators import fit_products

    fit = spark.createDataFrame([(9777485.172692884, 2.6387012796186737, 33449147 / 66060721)], "size double, r double, rate double")
    row = fit_products.saturation_costs(fit).where("saturation = 10").first()
    assert row["reads"] == pytest.approx(1550929.2146933074, rel=1e-9) and (row["molecules"], row["sequenced_reads"]) == (1395836, 3063023) and row["recovery"] == pytest.approx(14.276025670919434)
    row = fit_products.recovery_costs(fit).where("recovery = 11").first()
    assert row["reads"] == pytest.approx(1164942.1836903018, rel=1e-9) and (row["molecules"], row["sequenced_reads"]) == (1075523, 2300714) and row["saturation"] == pytest.approx(7.675815671025504)
    assert fit_products.saturation_costs(fit, 10, 95, 2.5).count() == 35


def test_products_of_a_library(spark, tmp_path):
    """A gamma-Poisson library: the baseline is near the target, the curve spaced by saturation, and the command saves what others read."""
    import numpy as np

    from cambium import cli
    from cambium.operators import fit_products

    draw = np.random.default_rng(4)
    seen = draw.poisson(draw.gamma(2.0, 2.0, 20_000))
    rows = [(int(i % 50), int(i % 31), int(i), False, int(n), 0, 0) for i, n in enumerate(seen) if n]
    prefix = str(tmp_path / "x")
    spark.createDataFrame(rows, "barcode long, gene long, umi long, random_hex boolean, spliced long, unspliced long, ambiguous long").write.parquet(f"{prefix}_tags.parquet")
    cli.main(["fit", prefix, "--points", "5", "--sat-step", "5"], spark)
    baseline, whole = fit_products.saved_baseline(spark, prefix)
    row = baseline.first()
    assert abs(row["saturation"] - 50) < 3 and row["fraction"] < 1 and row["saturation_mae"] < 3
    assert row["size"] == pytest.approx(20_000, rel=0.1) and row["full_molecules"] == len(rows) and row["spliced_r"] == pytest.approx(row["r"])
    assert whole.count() == 1 and whole.first()["seen"] == len(rows)
    curve = spark.read.parquet(f"{prefix}_fit_curve.parquet").orderBy("fraction").collect()
    gaps = np.diff([r["seen_saturation"] for r in curve])
    assert len(curve) == 5 and gaps.max() < 1.6 * gaps.min()
    wide = spark.read.parquet(f"{prefix}_fit_rpm_histograms.parquet")
    assert wide.count() == 50 and {"total", "full_total", "spliced", "full_ambiguous"} <= set(wide.columns)
    assert wide.agg({"full_total": "sum"}).first()[0] == len(rows)
    assert spark.read.parquet(f"{prefix}_fit_saturation_costs.parquet").count() == 18
    empty = str(tmp_path / "none")
    spark.read.parquet(f"{prefix}_tags.parquet").where("false").write.parquet(f"{empty}_tags.parquet")
    with pytest.raises(SystemExit):
        cli.main(["fit", empty], spark)
