"""Thinning and collapse in one row for each tag and seed against the plain steps, which have a row for each fraction too."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cambium.engine import Depth
from cambium.operators import limits, molecules, summaries, thinning

COLUMNS = ("seed", "frac_idx", "frac", "barcode", "gene", "umi", *thinning.CLASSES, "n_umis", "total", "valid")
SEEDS, FRACS = [3, -9, 3324115910], [0.5, 0.02, 1.0, 0.3, 0.5]


def some_tags(spark):
    draw = np.random.default_rng(8)
    rows = {(int(draw.integers(0, 4)), int(draw.integers(0, 6)), int(draw.integers(0, 256))): draw.negative_binomial(1, 0.1, 3).tolist() for _ in range(3000)}
    rows[0, 0, 0] = [thinning.READS + 9, 0, 5]  # more reads than are drawn at once
    return spark.createDataFrame([(*k, *v) for k, v in rows.items()], "barcode long, gene long, umi long, spliced long, unspliced long, ambiguous long")


@pytest.mark.parametrize("mode, multi", [("directed", True), ("directed", False), ("none", True)])
def test_packed_rows_hold_the_same_molecules(spark, mode, multi):
    tags = some_tags(spark)
    sample = Depth(tags, 4).downsample(FRACS, SEEDS, mode, multi)
    thin = thinning.thin(tags, FRACS, SEEDS, exact=False)
    plain = molecules.directional(thin, 4) if mode == "directed" else molecules.uncollapsed(thin)
    plain = molecules.mark_multi_gene(plain) if multi else plain.withColumns({"total": F.expr("spliced + unspliced + ambiguous"), "valid": F.lit(True)})
    rows = lambda df: sorted(tuple(r) for r in df.select(*COLUMNS).collect())
    want = rows(plain)
    assert rows(sample.molecules) == want and len({r[1] for r in want}) == 5
    counted = lambda df: sorted(tuple(r) for r in summaries.tally(df).collect())
    assert counted(sample.tallies) == counted(plain)
    for f in (summaries.bulk, summaries.by_class, lambda df: summaries.reads_histogram(df, 7)):
        assert sorted(map(tuple, f(sample.tallies).collect())) == sorted(map(tuple, f(plain).collect()))


def test_small_batches_and_missing_keys(spark):
    """Groups that go over many batches are whole; tags without reads, and missing numbers of reads, are no molecules."""
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    tags = some_tags(spark)
    want = sorted(tuple(r) for r in Depth(tags, 4).downsample([0.3], [1]).molecules.collect())
    odd = spark.createDataFrame([(9, 9, 9, None, 0, 0), (9, 9, 8, None, 2, None)], tags.schema)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(tuple(r) for r in Depth(tags, 4).downsample([0.3], [1]).molecules.collect()) == want
        found = Depth(tags.unionByName(odd), 4).downsample([1.0], [1]).molecules.where("barcode = 9").collect()
        assert [(r["umi"], r["spliced"], r["unspliced"], r["total"], r["valid"]) for r in found] == [(8, 0, 2, 2, True)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert Depth(tags.where("false"), 4).downsample([0.3], [1]).tallies.count() == 0


def test_no_row_is_dealt_for_each_fraction(spark):
    """Exchanges have a row for each tag and seed, whatever the number of fractions, and limits write a tally and not molecules."""
    tags = some_tags(spark)
    sample = Depth(tags, 4).downsample([i / 50 for i in range(1, 51)], [1, 2])
    for table in (sample.molecules, sample.tallies):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if "Exchange" in line and "frac_idx" in line]
    asked = [(None, 0.2), (None, 0.7)]
    tables = [limits.products(lambda f: getattr(Depth(tags, 4).downsample(f, [1, 2]), name), [1, 2], asked, 10**6)[0] for name in ("tallies", "molecules")]  # noqa: B023
    for name in ("stats", "summary", "histograms", "medians"):
        one, other = (sorted(map(str, getattr(t, name).collect())) for t in tables)
        assert one == other and one


def test_bytes_of_numbers():
    import pyarrow as pa

    parts = [np.arange(12).reshape(4, 3), np.asarray([[300, 0, 2**40]]), np.zeros((0, 3), np.int64), np.asarray([[70000, 1, 255]])]
    rows = [molecules.packed(p) for p in parts]
    assert [len(r[0].as_py()) if len(r) else None for r in rows] == [3, 24, None, 12]
    mixed = pa.concat_arrays(rows)
    for chunks in (rows, [mixed], [mixed.slice(2, 3)]):
        want = np.concatenate(parts)
        assert molecules.unpacked(pa.chunked_array(chunks), 3).tolist() == (want[2:5] if sum(map(len, chunks)) == 3 else want).tolist()
