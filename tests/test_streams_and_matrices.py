"""Streams against one batch of all reads, compressed rows against a plain matrix, and bounds of extrapolated curves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cambium import engine
from cambium.operators import curves, matrices
from cambium.session import kept
from cambium.sources import files, libraries
from cambium.streaming import alignments as streams
from test_files import GTF, alignments, as_sam


def test_stream_with_a_restart(spark, tmp_path):
    """A batch fails after it has written a part; the query starts again, more files come, and the tables are those of all reads at once."""
    rows, library = alignments(), libraries.BUILT_IN["10X_3p_v3"]
    (tmp_path / "g.gtf").write_text(GTF)
    (tmp_path / "in").mkdir()
    genes = kept(engine.genes_of(files.read_gtf(spark, str(tmp_path / "g.gtf"))))
    put = lambda i: (tmp_path / "in" / f"{i}.sam").write_text(as_sam(rows[i::4]))
    put(0)
    put(1)
    folder = str(tmp_path / "out")
    progress = streams.Progress()
    spark.streams.addListener(progress)

    status = lambda b: engine.raw_reads(b, genes, library).groupBy("status", "random_hex").agg(F.count(F.lit(1)).alias("n"))

    def broken(batch):
        if batch.where("qname = 's1' OR qname = 'u1' OR qname = 'a1'").count():
            raise RuntimeError("stopped")
        return status(batch)

    reads = lambda: files.stream_sam(spark, str(tmp_path / "in"))
    query = streams.in_batches(reads(), {"tags": lambda b: engine.molecule_tags(engine.raw_reads(b, genes, library), streams.ALL), "status": broken}, folder)
    with pytest.raises(Exception, match="stopped"):
        query.awaitTermination()
    streams.stream_reads(reads(), genes, library, folder).awaitTermination()
    put(2)
    put(3)
    query = streams.stream_reads(reads(), genes, library, folder)
    query.awaitTermination()
    whole = engine.raw_reads(files.read_sam(spark, str(tmp_path / "in")), genes, library)
    plain = lambda df, columns: sorted(map(str, df.select(columns).collect()))
    want = engine.molecule_tags(whole)
    assert plain(streams.streamed_tags(spark, folder), want.columns) == plain(want, want.columns)
    assert plain(streams.streamed_status(spark, folder), ["status", "random_hex", "n"]) == plain(whole.groupBy("status", "random_hex").agg(F.count(F.lit(1)).alias("n")), ["status", "random_hex", "n"])
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.streams.removeListener(progress)
    assert sum(c["rows"] for c in progress.counters.values()) >= len(rows)


@pytest.mark.parametrize("named", [False, True])
def test_compressed_rows(spark, named):
    draw = np.random.default_rng(2)
    x = draw.poisson(0.2, (70, 40))
    x[5] = 0
    entries = spark.createDataFrame([(100 + 3 * i, 7 * j, int(x[i, j])) for i in range(70) for j in range(40) if x[i, j]], "barcode long, gene long, value long").repartition(5)
    rows = spark.createDataFrame([(100 + 3 * i,) for i in range(0, 70, 1 if not named else 2)], "barcode long")
    columns = spark.createDataFrame([(7 * j,) for j in range(10, 40)] + [(9999,)], "gene long") if named else None
    found = matrices.compressed(entries, rows=rows, columns=columns)
    kept_rows = sorted(found.rows.collect(), key=lambda r: r["row_number"])
    kept_columns = {r["column_number"]: r["gene"] for r in found.columns.collect()}
    ordered = sorted(found.entries.collect(), key=lambda r: r["position"])
    assert [r["row_number"] for r in kept_rows] == list(range(len(kept_rows))) and [e["position"] for e in ordered] == list(range(len(ordered)))
    want = x[::2, 10:] if named else x
    out = np.zeros((len(kept_rows), max(kept_columns) + 1), int)
    for r in kept_rows:
        part = ordered[r["start"] : r["start"] + r["n"]]
        assert all(e["row_number"] == r["row_number"] for e in part)
        for e in part:
            out[r["row_number"], e["column_number"]] = e["value"]
    assert (out[:, : want.shape[1]] == want).all() and out.sum() == want.sum()
    assert any(r["n"] == 0 for r in kept_rows) or named


def test_matrix_is_written_in_order(spark, tmp_path):
    entries = spark.createDataFrame([(i % 9, i % 11, 1) for i in range(99)], "barcode long, gene long, value long")
    matrices.compressed(entries).write(str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m_entries.parquet")).orderBy("position").collect()
    assert [(r["row_number"], r["column_number"]) for r in back] == [(i, j) for i in range(9) for j in range(11)]
    assert matrices.compressed(entries.where("false")).rows.count() == 0


def test_bounds_hold_the_truth(spark):
    """Molecules of a gamma-Poisson library: the truth is between the bounds, and they widen."""
    draw = np.random.default_rng(3)
    seen = draw.poisson(draw.gamma(1.5, 0.6, 50_000))
    rows = [("a", i + 1, int(n)) for i, n in enumerate(np.bincount(seen)[1:])]
    hist = spark.createDataFrame(rows, "name string, bin long, n long")
    found = {r["times"]: r for r in curves.extrapolate_bounds(hist, "name", most=2.0, points=4, replicates=40).collect()}
    truth = lambda t: (1 - (1 + 0.6 * t) ** -1.5) * 50_000
    assert set(found) == {1.0, 1.5, 2.0, 2.5, 3.0}
    for t, r in found.items():
        assert r["lower"] <= r["molecules"] <= r["upper"] and r["stable"] > 0.5
    assert found[2.0]["lower"] * 0.98 < truth(2.0) < found[2.0]["upper"] * 1.02
    assert found[3.0]["upper"] - found[3.0]["lower"] > found[1.5]["upper"] - found[1.5]["lower"]
    again = {r["times"]: r for r in curves.extrapolate_bounds(hist.repartition(3), "name", most=2.0, points=4, replicates=40).collect()}
    assert again == found
