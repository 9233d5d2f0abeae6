"""Binary sources, the way from alignments to a molecule table, and the command line."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cambium import cli
from cambium.engine import Depth
from cambium.operators import communities, curves, droplets
from cambium.sources import binary, files

GTF = """# an annotation
chr1\tx\tgene\t101\t400\t.\t+\t.\tgene_id "G1"; gene_name "one";
chr1\tx\texon\t101\t200\t.\t+\t.\tgene_id "G1"; transcript_id "T1";
chr1\tx\texon\t301\t400\t.\t+\t.\tgene_id "G1"; transcript_id "T1";
chr2\tx\tgene\t1001\t1400\t.\t-\t.\tgene_id "G2";
chr2\tx\texon\t1001\t1400\t.\t-\t.\tgene_id "G2"; transcript_id "T2";
"""
UMIS = ["ACGTACGTACGT", "TTTTACGTACGA", "GGGGACGTACGC"]


def blocked(raw: bytes, size: int = 100) -> bytes:
    """Blocked gzip: members with their size in an extra field, and an empty one at the end."""
    out = b""
    for start in [*range(0, len(raw), size), len(raw)]:
        part = raw[start : start + size]
        squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = squeeze.compress(part) + squeeze.flush()
        out += b"\x1f\x8b\x08\x04" + bytes(4) + b"\0\xff" + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def alignments() -> list[tuple]:
    """qname, flag, chrom, pos (from 0), mapq, cigar, barcode, umi; of one barcode, with reads of each status."""
    rows = []
    for i in range(30):
        rows.append((f"s{i}", 0, "chr1", 150, 255, "50M100N50M", "ACGT-1", UMIS[i % 3]))  # spliced
        rows.append((f"u{i}", 0, "chr1", 180, 255, "100M", "ACGT-1", UMIS[i % 2]))  # reaches into the intron
        rows.append((f"a{i}", 16, "chr2", 1050, 255, "60M", "CCCC-1", UMIS[0]))  # one exon, other strand
    rows += [("low", 0, "chr1", 150, 3, "50M", "ACGT-1", UMIS[0]), ("none", 4, None, -1, 0, "*", "ACGT-1", UMIS[0]), ("bad", 0, "chr1", 150, 255, "50M", None, UMIS[0]), ("off", 0, "chr2", 5000, 255, "60M", "ACGT-1", UMIS[0])]
    return rows


def as_sam(rows) -> str:
    lines = ["@HD\tVN:1.6", "@SQ\tSN:chr1\tLN:100000"]
    for name, flag, chrom, pos, mapq, cigar, cb, umi in rows:
        lines.append("\t".join([name, str(flag), chrom or "*", str(pos + 1), str(mapq), cigar, "*", "0", "0", "ACG", "III", "NH:i:1", *([f"CB:Z:{cb}"] if cb else []), f"UR:Z:{umi}"]))
    return "\n".join(lines) + "\n"


def as_bam(rows) -> bytes:
    chroms = ["chr1", "chr2"]
    out = b"BAM\1" + struct.pack("<i", 5) + b"@HD\t\n" + struct.pack("<i", 2) + b"".join(struct.pack("<i", 5) + c.encode() + b"\0" + struct.pack("<i", 10**6) for c in chroms)
    for name, flag, chrom, pos, mapq, cigar, cb, umi in rows:
        ops, n = [], ""
        for c in cigar if cigar != "*" else "":
            if c.isdigit():
                n += c
            else:
                ops.append(int(n) << 4 | "MIDNSHP=X".index(c))
                n = ""
        tags = b"NHC\1" + b"ZBBs" + struct.pack("<i2h", 2, 7, 8) + (b"CBZ" + cb.encode() + b"\0" if cb else b"") + b"URZ" + umi.encode() + b"\0"
        body = struct.pack("<iiBBHHHiiii", chroms.index(chrom) if chrom else -1, pos, len(name) + 1, mapq, 0, len(ops), flag, 3, -1, -1, 0) + name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + b"\x12\x40" + b"III" + tags
        out += struct.pack("<i", len(body)) + body
    return out


def test_bam_equals_sam(spark, tmp_path):
    rows = alignments()
    (tmp_path / "a.sam").write_text(as_sam(rows))
    (tmp_path / "a.bam").write_bytes(blocked(as_bam(rows)))
    found = binary.read_bam(spark, str(tmp_path / "a.bam"))
    text = files.read_sam(spark, str(tmp_path / "a.sam"))
    assert found.columns == text.columns and sorted(found.collect(), key=str) == sorted(text.collect(), key=str)
    (tmp_path / "cut.bam").write_bytes(blocked(as_bam(rows)[:-3]))
    with pytest.raises(Exception, match="ends within a record"):
        binary.read_bam(spark, str(tmp_path / "cut.bam")).count()


def test_tag_file(spark, tmp_path):
    tags = [(g, g * 7, g % 3, 65535, 0, 16 if g % 2 else 0) for g in range(50)]
    raw = struct.pack("<III", 3, 50, 800) + b"".join(struct.pack("<IIHHHH", *t) for t in tags) + struct.pack("<III", 4, 0, 0)
    (tmp_path / "t.bin").write_bytes(blocked(raw))
    found = binary.read_tag_file(spark, str(tmp_path / "t.bin")).orderBy("gene").collect()
    assert [tuple(r) for r in found] == [(3, *t) for t in tags]


def test_cache_and_fit(spark, tmp_path):
    (tmp_path / "a.bam").write_bytes(blocked(as_bam(alignments())))
    (tmp_path / "g.gtf").write_text(GTF)
    prefix = str(tmp_path / "x")
    cli.main(["cache", prefix, "--alignments", str(tmp_path / "a.bam"), "--annotation", str(tmp_path / "g.gtf")], spark)
    status = {r["status"]: r["n"] for r in spark.read.parquet(f"{prefix}_summary.parquet").groupBy("status").agg(F.sum("n").alias("n")).collect()}
    assert status == {"countable": 90, "low_quality": 2, "bad_tags": 1, "no_gene": 1}
    tags = spark.read.parquet(f"{prefix}_tags.parquet")
    sums = tags.groupBy("gene").agg(*[F.sum(c) for c in ("spliced", "unspliced", "ambiguous")]).orderBy("gene").collect()
    assert [tuple(r) for r in sums] == [(0, 30, 30, 0), (1, 0, 0, 30)]
    index = {r["cb"]: r for r in spark.read.parquet(f"{prefix}_barcodes.parquet").collect()}
    assert index["ACGT-1"]["total_reads"] == 63 and index["ACGT-1"]["countable_reads"] == 60 and index["ACGT-1"]["raw_molecules"] == 3
    cli.main(["fit", prefix, "--points", "4"], spark)
    assert spark.read.parquet(f"{prefix}_fit_curve.parquet").count() == 4
    cli.main(["preseq", prefix], spark)
    assert spark.read.parquet(f"{prefix}_preseq_summary.parquet").count() == 1


def test_depth_modes(spark):
    tags = spark.createDataFrame([(1, 1, 0, True, 9, 0, 0), (1, 1, 1, True, 2, 0, 0), (1, 2, 0, False, 4, 0, 0), (2, 1, 0, False, 0, 3, 0)], "barcode long, gene long, umi long, random_hex boolean, spliced long, unspliced long, ambiguous long")
    size = lambda sample: (lambda r: (r["molecules"], r["reads"], r["molecules_discarded"]))(sample.bulk().first())
    depth = Depth(tags, 6)
    assert size(depth.downsample([1.0])) == (2, 14, 1)
    assert size(depth.downsample([1.0], umi_mode="none", multi_gene=False)) == (4, 18, 0)
    assert size(depth.downsample([1.0], primers="random_hex")) == (1, 11, 0)
    out = Depth(tags, 6, spark.createDataFrame([(1,)], "gene long"))
    assert size(out.downsample([1.0])) == (1, 4, 0)
    barcodes, starts, genes, values = depth.downsample([1.0]).csr(42, 0)
    assert list(barcodes) == [1, 2] and list(starts) == [0, 2, 3] and list(genes) == [1, 2, 1] and list(values) == [1, 0, 1]
    for wrong in ({"fracs": [1.5]}, {"fracs": []}, {"fracs": [1.0], "umi_mode": "x"}):
        with pytest.raises(ValueError):
            depth.downsample(**wrong)


def test_communities_of_cliques(spark):
    cliques = [(10 * c + i, 10 * c + j, 1.0) for c in range(6) for i in range(6) for j in range(i)]
    ring = [(10 * c, 10 * ((c + 1) % 6) + 1, 1.0) for c in range(6)]
    edges = spark.createDataFrame(cliques + ring, "a long, b long, weight double")
    found = {r["id"]: r["community"] for r in communities.communities(edges).collect()}
    assert len(found) == 36 and len(set(found.values())) == 6
    assert all(len({found[10 * c + i] for i in range(6)}) == 1 for c in range(6))
    value = communities.modularity(edges, spark.createDataFrame(list(found.items()), "id long, community long")).first()[0]
    assert value == pytest.approx(90 / 96 - 1 / 6)
    empty = spark.createDataFrame([], "a long, b long, weight double")
    assert communities.communities(empty).count() == 0


def test_droplets(spark):
    draw = np.random.default_rng(5)
    ambient, cell = np.ones(40) / 40, np.r_[np.ones(8) / 9, np.ones(32) / 288]
    rows = []
    for barcode in range(120):
        kind, size = (ambient, 40) if barcode < 80 else (ambient, 300) if barcode < 100 else (cell, 300)
        rows += [(barcode, g, int(n)) for g, n in enumerate(draw.multinomial(size, kind / kind.sum())) if n]
    rows += [(500, g, 100) for g in range(40)]
    counts = spark.createDataFrame(rows, "barcode long, gene long, value long")
    found = {r["barcode"]: r for r in droplets.droplet_calls(counts, 100, 2000, 1000).collect()}
    assert set(found) == {*range(80, 120), 500}
    assert all(found[b]["is_cell"] == 1 for b in [*range(100, 120), 500]) and sum(found[b]["is_cell"] for b in range(80, 100)) <= 1
    again = {r["barcode"]: r for r in droplets.droplet_calls(counts.repartition(7), 100, 2000, 1000).collect()}
    assert again == found


def test_extrapolation(spark):
    """Molecules drawn from a gamma-Poisson library: the curve stays near the truth at four times the reads."""
    draw = np.random.default_rng(3)
    rates = draw.gamma(1.5, 0.6, 200_000)
    seen = draw.poisson(rates)
    counts = np.bincount(seen)[1:]
    hist = spark.createDataFrame([(1, i + 1, int(n)) for i, n in enumerate(counts)], "seed long, bin long, n long")
    found = {round(r["times"], 6): r["molecules"] for r in curves.extrapolate(hist, "seed", most=3.0, points=3).collect()}
    truth = lambda t: (1 - (1 + 0.6 * t) ** -1.5) * 200_000
    assert found[1.0] == counts.sum() and found[4.0] == pytest.approx(truth(4), rel=0.03)
    assert curves.least_size(hist, "seed").first()["least_size"] <= 200_000


def test_known_junctions_and_samples(spark, tmp_path):
    rows = [("k", 0, "chr1", 150, 255, "50M100N50M", "ACGT-1", UMIS[0]), ("x", 0, "chr1", 150, 255, "40M120N50M", "ACGT-1", UMIS[1])]
    (tmp_path / "a.sam").write_text("".join(f"{line}\tCR:Z:s{i % 2}\n" for i, line in enumerate(as_sam(rows).splitlines()[2:])))
    (tmp_path / "g.gtf").write_text(GTF)
    cache = ["cache", "--alignments", str(tmp_path / "a.sam"), "--annotation", str(tmp_path / "g.gtf")]
    found = []
    for i, more in enumerate(([], ["--known-junctions"], ["--samples", "s1"])):
        prefix = str(tmp_path / f"p{i}")
        cli.main([*cache, prefix, *more], spark)
        found.append(({r["status"]: r["n"] for r in spark.read.parquet(f"{prefix}_summary.parquet").collect()}, [r["cb"] for r in spark.read.parquet(f"{prefix}_barcodes.parquet").collect()]))
    assert found == [({"countable": 2}, ["ACGT-1"]), ({"countable": 1, "no_gene": 1}, ["ACGT-1"]), ({"countable": 1, "bad_tags": 1}, ["s1_ACGT-1"])]


def test_lists_and_annotation(spark, tmp_path):
    (tmp_path / "ids").write_text("# ids\nG1\nG9\n")
    genes = spark.createDataFrame([("G1",)], "gene_id string")
    assert [r[0] for r in files.unknown_genes(files.read_gene_list(spark, str(tmp_path / "ids")), genes).collect()] == ["G9"]
    codes = spark.createDataFrame([(1,), (2,)], "barcode long")
    meta = spark.createDataFrame([(2, "x")], "barcode long, kind string")
    assert {tuple(r) for r in files.annotated(codes, None, meta).collect()} == {(1, None), (2, "x")}
    assert files.annotated(codes, None).columns == ["barcode"]


def test_commands_on_a_table(spark, tmp_path):
    """Two kinds of cells, eight genes each of their own: the commands run, and replicates agree on the kinds."""
    draw = np.random.default_rng(1)
    rows = []
    for barcode in range(40):
        for n in range(60):
            gene = int(draw.integers(8)) + 8 * (barcode % 2) if n % 6 else 16 + int(draw.integers(4))
            rows.append((barcode, gene, int(draw.integers(4**9)), False, int(draw.geometric(0.4)), 0, 0))
    prefix = str(tmp_path / "x")
    spark.createDataFrame(rows, "barcode long, gene long, umi long, random_hex boolean, spliced long, unspliced long, ambiguous long").write.parquet(f"{prefix}_tags.parquet")
    read = lambda name: spark.read.parquet(f"{prefix}_{name}.parquet")
    cli.main(["emptydrops", prefix, "--lower", "20", "--iterations", "200"], spark)
    assert read("emptydrops").count() == 40
    cli.main(["filter", prefix, "--least", "10"], spark)
    assert "passed" in read("passed").columns
    cli.main(["limit", prefix, "--points", "3", "--repeats", "2", "--cells", "40"], spark)
    assert read("limit_summary").count() == 6 and read("pilot_summary").count() >= 1
    cli.main(["genes", prefix, "--points", "2", "--repeats", "2"], spark)
    assert read("genes_summary").where("frac_idx = 1").first()["median_stability"] == 1.0
    cli.main(["stability", prefix, "--repeats", "2", "--frac", "0.9", "--top-genes", "16", "--components", "3", "--neighbours", "8", "--resolutions", "0.5,1"], spark)
    assert read("stability_summary").where("resolution = 0.5").first()["median_ari"] > 0.8
    assert read("stability_clusters").count() == 4 and read("stability_genes").first()["jaccard"] > 0.5 and read("stability_neighbours").first()["mean"] > 0.3
