"""Every query of the depth and saturation operators, with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..engine import Depth
from ..functions import library, sequences
from ..operators import annotate, cells, classify, communities, curves, densities, droplets, fit_products, fitting, interpolation, limits, matrices, molecules, numbering, stability, summaries, thinning
from ..operators import neighbours as lists
from ..session import kept, scratch
from ..sources import binary, libraries
from ..streaming import alignments as streams
from ..streaming import windows
from . import fixtures as fx

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

FRACS = [0.1, 0.25, 0.5, 1.0]
SEEDS = [369133708, 3324115910]


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


# --- SQL of the shared steps -------------------------------------------------

RAW = f"WITH RECURSIVE raw AS ({fx.RAW_SQL})"
TAGS = f"{RAW}, tags AS ({fx.tags_sql()})"


def thin_sql(fracs=FRACS, seeds=(42,), source: str = "tags", keys: str = "barcode, gene, umi") -> str:
    counted = ", ".join(
        f"""CASE WHEN frac = 1 THEN {c} ELSE len(list_filter(range(1, {c} + 1),
        lambda i: CAST('0x' || substr(md5(concat_ws('|', seed, barcode, gene, umi, '{c}', i)), 1, 8) AS BIGINT) < frac * 4294967296)) END AS {c}"""
        for c in thinning.CLASSES
    )
    grid = ", ".join(f"({i}, CAST({f} AS DOUBLE))" for i, f in enumerate(fracs))
    every = ", ".join(f"({s})" for s in seeds)
    return f"""thinned AS (
  SELECT * FROM (SELECT seed, frac_idx, frac, {keys}, {counted}
  FROM {source}, (VALUES {grid}) g(frac_idx, frac), (SELECT CAST(s AS BIGINT) AS seed FROM (VALUES {every}) v(s)))
  WHERE spliced + unspliced + ambiguous > 0)"""


COLLAPSE = """nodes AS (
  SELECT *, spliced + unspliced + ambiguous AS total,
         row_number() OVER (PARTITION BY seed, frac_idx, barcode, gene ORDER BY spliced + unspliced + ambiguous DESC, umi) AS rank
  FROM thinned
), edges AS (
  SELECT x.seed, x.frac_idx, x.barcode, x.gene, x.rank AS a, y.rank AS b FROM nodes x JOIN nodes y USING (seed, frac_idx, barcode, gene)
  WHERE bit_count((xor(x.umi, y.umi) | (xor(x.umi, y.umi) >> 1)) & 1431655765) = 1 AND x.total >= 2 * y.total - 1
), reach AS (
  SELECT seed, frac_idx, barcode, gene, rank AS root, rank AS node FROM nodes
  UNION SELECT r.seed, r.frac_idx, r.barcode, r.gene, r.root, e.b
  FROM reach r JOIN edges e ON e.seed = r.seed AND e.frac_idx = r.frac_idx AND e.barcode = r.barcode AND e.gene = r.gene AND e.a = r.node
), label AS (SELECT seed, frac_idx, barcode, gene, node, min(root) AS root FROM reach GROUP BY ALL
), mols AS (
  SELECT l.seed, l.frac_idx, l.barcode, l.gene, max(n.umi) FILTER (n.rank = l.root) AS umi, sum(n.spliced)::BIGINT AS spliced,
         sum(n.unspliced)::BIGINT AS unspliced, sum(n.ambiguous)::BIGINT AS ambiguous, count(*) AS n_umis, sum(n.total)::BIGINT AS total
  FROM label l JOIN nodes n ON n.seed = l.seed AND n.frac_idx = l.frac_idx AND n.barcode = l.barcode AND n.gene = l.gene AND n.rank = l.node
  GROUP BY l.seed, l.frac_idx, l.barcode, l.gene, l.root
)"""
VALID = """judged AS (
  SELECT *, total = max(total) OVER s AND count(*) OVER (PARTITION BY seed, frac_idx, barcode, umi, total) = 1 AS valid,
         CASE WHEN spliced > 0 THEN 'spliced' WHEN unspliced > 0 THEN 'unspliced' ELSE 'ambiguous' END AS class
  FROM mols WINDOW s AS (PARTITION BY seed, frac_idx, barcode, umi)
)"""
MOLS = f"{TAGS}, {thin_sql()}, {COLLAPSE}"
JUDGED = f"{MOLS}, {VALID}"
FULL = f"{TAGS}, {thin_sql([1.0])}, {COLLAPSE}, {VALID}"
SPOT_TAGS = f"{RAW}, tags AS (SELECT spot AS barcode, gene, umi, " + ", ".join(f"count(*) FILTER (class = '{c}') AS {c}" for c in thinning.CLASSES) + " FROM raw GROUP BY ALL)"
SPOT_FULL = f"{SPOT_TAGS}, {thin_sql([1.0])}, {COLLAPSE}, {VALID}"


# --- shared steps in Spark ---------------------------------------------------


def judged(spark, sf_dir, fracs=FRACS, seeds=(42,)):
    thinned = thinning.thin(fx.tags(spark, sf_dir), fracs, seeds)
    return molecules.mark_multi_gene(molecules.directional(thinned, fx.UMI_LENGTH))


def spot_molecules(spark, sf_dir):
    raw = fx.raw_tags(spark, sf_dir).drop("barcode").withColumnRenamed("spot", "barcode")
    tags = raw.groupBy("barcode", "gene", "umi").agg(*[F.count_if(F.col("class") == c).alias(c) for c in thinning.CLASSES])
    return molecules.mark_multi_gene(molecules.directional(thinning.thin(tags, [1.0]), fx.UMI_LENGTH))


# --- tags and dimensions -----------------------------------------------------


@query("tag_collapse", f"{RAW} {fx.tags_sql('random_hex')}")
def tag_collapse(spark, sf_dir):
    return fx.tags(spark, sf_dir, "random_hex")


@query("tag_collapse_saturating", f"{TAGS} SELECT barcode, gene, umi, least(spliced, 2) AS spliced, least(unspliced, 2) AS unspliced, least(ambiguous, 2) AS ambiguous, spliced > 2 AS spliced_over FROM tags")
def tag_collapse_saturating(spark, sf_dir):
    top = 2  # 65535 in production; small here so that the test data reach it
    return fx.tags(spark, sf_dir).select("barcode", "gene", "umi", *[F.least(c, F.lit(top)).alias(c) for c in thinning.CLASSES], (F.col("spliced") > top).alias("spliced_over"))


@query("barcode_index", f"""{RAW} SELECT barcode, count(*) AS countable_reads, count(DISTINCT (gene, umi, random_hex)) AS raw_molecules,
  count(*) FILTER (random_hex) AS random_hex_reads, count(*) FILTER (NOT random_hex) AS poly_a_reads FROM raw GROUP BY barcode""")
def barcode_index(spark, sf_dir):
    return fx.raw_tags(spark, sf_dir).groupBy("barcode", "gene", "umi", "random_hex").agg(F.count(F.lit(1)).alias("n")).groupBy("barcode").agg(
        F.sum("n").alias("countable_reads"), F.count(F.lit(1)).alias("raw_molecules"),
        F.sum(F.when(F.col("random_hex"), F.col("n")).otherwise(0)).alias("random_hex_reads"), F.sum(F.when(~F.col("random_hex"), F.col("n")).otherwise(0)).alias("poly_a_reads"),
    )


@query("gene_map", "SELECT row_number() OVER (ORDER BY p_partkey % 5, p_partkey * 40, p_partkey * 40 + p_size * 20, 'g' || p_partkey) - 1 AS gene_index, 'g' || p_partkey AS gene_id, p_name AS gene_name FROM part")
def gene_map(spark, sf_dir):
    key = F.col("p_partkey").cast("long")
    genes = fx.table(spark, sf_dir, "part").select((key % 5).alias("chrom"), (key * 40).alias("lft"), (key * 40 + F.col("p_size") * 20).alias("rgt"), F.concat(F.lit("g"), key.cast("string")).alias("gene_id"), F.col("p_name").alias("gene_name"))
    return numbering.numbered(genes, ["chrom", "lft", "rgt", "gene_id"], "gene_index").select("gene_index", "gene_id", "gene_name")


@query("barcode_numbers", "SELECT row_number() OVER (ORDER BY cb) - 1 AS barcode_idx, cb, total_reads FROM (SELECT 'c' || (l_suppkey * 7919 % 100003) AS cb, count(*) AS total_reads FROM lineitem GROUP BY 1)")
def barcode_numbers(spark, sf_dir):
    """Barcodes numbered without gaps by their sequence."""
    totals = fx.table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("c"), (F.col("l_suppkey").cast("long") * 7919 % 100003).cast("string")).alias("cb")).agg(F.count(F.lit(1)).alias("total_reads"))
    return numbering.numbered(totals, ["cb"], "barcode_idx").select("barcode_idx", "cb", "total_reads")


STATUS_READS = """reads AS (
  SELECT 's' || (l_suppkey % 3) AS sample, CASE WHEN l_linenumber = 7 THEN NULL ELSE 'ACGT' || substr('ACGTNACGTA', CAST(l_suppkey % 7 AS INTEGER) + 1, 4) || '-1' END AS cb,
    CASE WHEN l_partkey % 11 = 0 THEN 'ACG' ELSE substr('ACGTTGCANACGGTAC', CAST(l_partkey % 10 AS INTEGER) + 1, 6) END AS umi,
    CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE 'chr1' END AS chrom, CASE WHEN l_partkey % 5 = 0 THEN 4 ELSE 16 END AS flag, CASE WHEN l_quantity > 40 THEN 3 ELSE 255 END AS mapq
  FROM lineitem
), judged AS (
  SELECT *, CASE WHEN cb IS NULL OR umi IS NULL OR length(umi) <> 6 OR NOT regexp_full_match(cb, '[ACGT]+-[0-9]+') OR NOT regexp_full_match(umi, '[ACGTacgt]+') THEN 'bad_tags'
    WHEN chrom IS NULL OR (flag & 4) <> 0 OR mapq < 255 THEN 'low_quality' ELSE 'countable' END AS status FROM reads
)"""


def status_reads(spark, sf_dir, primer=None):
    reads = fx.table(spark, sf_dir, "lineitem").selectExpr(
        "concat('s', l_suppkey % 3) AS sample",
        "CASE WHEN l_linenumber = 7 THEN NULL ELSE concat('ACGT', substr('ACGTNACGTA', cast(l_suppkey % 7 as int) + 1, 4), '-1') END AS cb",
        "CASE WHEN l_partkey % 11 = 0 THEN 'ACG' ELSE substr('ACGTTGCANACGGTAC', cast(l_partkey % 10 as int) + 1, 6) END AS umi",
        "CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE 'chr1' END AS chrom",
        "CASE WHEN l_partkey % 5 = 0 THEN 4 ELSE 16 END AS flag",
        "CASE WHEN l_quantity > 40 THEN 3 ELSE 255 END AS mapq",
        *([f"{primer} AS random_hex"] if primer else []),
    )
    return classify.read_status(reads, 6, "[ACGT]+-[0-9]+")


@query("read_status_counts", f"WITH {STATUS_READS} SELECT status, count(*) AS n FROM judged GROUP BY status")
def read_status_counts(spark, sf_dir):
    return status_reads(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("read_status_by_sample", f"WITH {STATUS_READS} SELECT sample, status, count(*) AS n FROM judged GROUP BY ROLLUP (sample, status)")
def read_status_by_sample(spark, sf_dir):
    return status_reads(spark, sf_dir).rollup("sample", "status").agg(F.count(F.lit(1)).alias("n"))


PRIMER = "l_linenumber % 3 = 0"


@query("sample_summary", f"""WITH {STATUS_READS.replace("AS mapq", f"AS mapq, {PRIMER} AS random_hex")}, c AS (SELECT sample, """ + ", ".join(
    f"count(*) FILTER ({test} AND {whose}) AS {prefix}{name}" for prefix, whose in (("", "true"), ("polyA_", "NOT random_hex"), ("random_hex_", "random_hex"))
    for name, test in (("total_reads", "true"), *((s, f"status = '{s}'") for s in (*classify.STATUSES, "no_gene")))) + """ FROM judged GROUP BY sample)
  SELECT sample || '_' || key AS key, 'reads' AS type, CAST(value AS VARCHAR) AS value FROM (UNPIVOT c ON COLUMNS(* EXCLUDE sample) INTO NAME key VALUE value)""")  # fmt: skip
def sample_summary(spark, sf_dir):
    return classify.read_summary(status_reads(spark, sf_dir, PRIMER), True, "sample")


@query("sample_whitelist", f"WITH {STATUS_READS} SELECT sample || '_' || cb AS barcode, count(*) AS n FROM judged WHERE status = 'countable' AND sample IN ('s0', 's2') GROUP BY ALL")
def sample_whitelist(spark, sf_dir):
    allowed = spark.createDataFrame([("s0",), ("s2",)], "sample string")
    chosen = status_reads(spark, sf_dir).where("status = 'countable'").join(F.broadcast(allowed), "sample", "left_semi")  # a given list
    return chosen.groupBy(F.concat_ws("_", "sample", "cb").alias("barcode")).agg(F.count(F.lit(1)).alias("n"))


@query("umi_encode", f"WITH {STATUS_READS}, u AS (SELECT DISTINCT umi FROM reads WHERE umi IS NOT NULL) SELECT umi, CASE WHEN regexp_full_match(umi, '[ACGT]+') THEN CAST(list_sum(list_transform(range(1, length(umi) + 1), lambda i: (instr('ACGT', substr(umi, CAST(i AS INTEGER), 1)) - 1) * power(4, length(umi) - i))) AS BIGINT) END AS code, CASE WHEN length(umi) = 6 AND regexp_full_match(umi, '[ACGT]+') THEN umi END AS decoded FROM u")
def umi_encode(spark, sf_dir):
    codes = status_reads(spark, sf_dir).where("umi is not null").select("umi", F.col("umi_code").alias("code")).distinct()
    return codes.withColumn("decoded", F.when(F.length("umi") == 6, sequences.decode(F.col("code"), 6)))


@query("summary_eav", f"""WITH {STATUS_READS}, c AS (SELECT count(*) AS total_reads, count(*) FILTER (status = 'bad_tags') AS bad_tags, count(*) FILTER (status = 'low_quality') AS low_quality,
  count(*) FILTER (status = 'countable') AS countable FROM judged) SELECT key, 'reads' AS type, CAST(value AS VARCHAR) AS value FROM (UNPIVOT c ON total_reads, bad_tags, low_quality, countable INTO NAME key VALUE value)""")
def summary_eav(spark, sf_dir):
    counts = status_reads(spark, sf_dir).agg(F.count(F.lit(1)).alias("total_reads"), *[F.count_if(F.col("status") == s).alias(s) for s in classify.STATUSES])
    return counts.unpivot([], ["total_reads", *classify.STATUSES], "key", "value").select("key", F.lit("reads").alias("type"), F.col("value").cast("string").alias("value"))


# --- thinning ----------------------------------------------------------------


@query("thin_bulk", f"{TAGS}, {thin_sql()} SELECT frac_idx, sum(spliced + unspliced + ambiguous)::BIGINT AS reads, count(*) AS tags FROM thinned GROUP BY frac_idx")
def thin_bulk(spark, sf_dir):
    return thinning.thin(fx.tags(spark, sf_dir), FRACS).groupBy("frac_idx").agg(F.sum(F.expr("spliced + unspliced + ambiguous")).alias("reads"), F.count(F.lit(1)).alias("tags"))


@query("thin_grid_multi_seed", f"{TAGS}, {thin_sql(seeds=SEEDS)} SELECT seed, frac_idx, sum(spliced)::BIGINT AS spliced, sum(unspliced)::BIGINT AS unspliced, sum(ambiguous)::BIGINT AS ambiguous FROM thinned GROUP BY seed, frac_idx")
def thin_grid_multi_seed(spark, sf_dir):
    return thinning.thin(fx.tags(spark, sf_dir), FRACS, SEEDS).groupBy("seed", "frac_idx").agg(*[F.sum(c).alias(c) for c in thinning.CLASSES])


@query("primer_filter", f"{RAW}, tags AS ({fx.tags_sql('random_hex')}) SELECT random_hex, count(*) AS tags, sum(spliced + unspliced + ambiguous)::BIGINT AS reads FROM tags WHERE NOT random_hex GROUP BY random_hex")
def primer_filter(spark, sf_dir):
    chosen = fx.tags(spark, sf_dir, "random_hex").where(~F.col("random_hex"))
    return chosen.groupBy("random_hex").agg(F.count(F.lit(1)).alias("tags"), F.sum(F.expr("spliced + unspliced + ambiguous")).alias("reads"))


# --- UMI correction ----------------------------------------------------------


@query("umi_pairs_hamming1", f"{TAGS} SELECT x.barcode, x.gene, x.umi AS umi_a, y.umi AS umi_b FROM tags x JOIN tags y ON x.barcode = y.barcode AND x.gene = y.gene AND x.umi < y.umi AND bit_count((xor(x.umi, y.umi) | (xor(x.umi, y.umi) >> 1)) & 1431655765) = 1")
def umi_pairs_hamming1(spark, sf_dir):
    return molecules.hamming_pairs(fx.tags(spark, sf_dir), fx.UMI_LENGTH).select("barcode", "gene", "umi_a", "umi_b")


@query("umi_neighbours", f"{TAGS}, u AS (SELECT DISTINCT umi FROM tags) SELECT umi, xor(umi, k << CAST(2 * i AS INTEGER)) AS neighbour FROM u, range(0, 6) a(i), range(1, 4) b(k)")
def umi_neighbours(spark, sf_dir):
    return fx.tags(spark, sf_dir).select("umi").distinct().select("umi", F.explode(sequences.neighbours(F.col("umi"), fx.UMI_LENGTH)).alias("neighbour"))


@query("umi_directional", f"{MOLS} SELECT seed, frac_idx, barcode, gene, umi, spliced, unspliced, ambiguous, n_umis FROM mols")
def umi_directional(spark, sf_dir):
    return molecules.directional(thinning.thin(fx.tags(spark, sf_dir), FRACS), fx.UMI_LENGTH).drop("frac")


@query("umi_none", f"{TAGS}, {thin_sql()} SELECT frac_idx, count(*) AS molecules FROM thinned GROUP BY frac_idx")
def umi_none(spark, sf_dir):
    return molecules.uncollapsed(thinning.thin(fx.tags(spark, sf_dir), FRACS)).groupBy("frac_idx").agg(F.count(F.lit(1)).alias("molecules"))


@query("multi_gene_discard", f"{JUDGED} SELECT seed, frac_idx, barcode, gene, umi, total, valid FROM judged")
def multi_gene_discard(spark, sf_dir):
    return judged(spark, sf_dir).select("seed", "frac_idx", "barcode", "gene", "umi", "total", "valid")


@query("discard_totals", f"{JUDGED} SELECT frac_idx, barcode, coalesce(sum(total) FILTER (NOT valid), 0)::BIGINT AS reads_discarded, count(*) FILTER (NOT valid) AS molecules_discarded FROM judged GROUP BY frac_idx, barcode")
def discard_totals(spark, sf_dir):
    return judged(spark, sf_dir).groupBy("frac_idx", "barcode").agg(F.sum(F.when(~F.col("valid"), F.col("total")).otherwise(0)).alias("reads_discarded"), F.count_if(~F.col("valid")).alias("molecules_discarded"))


# --- summaries ---------------------------------------------------------------


@query("bulk_saturation", f"""{JUDGED}, b AS (SELECT seed, frac_idx, coalesce(sum(total) FILTER (valid), 0)::BIGINT AS reads, count(*) FILTER (valid) AS molecules,
  coalesce(sum(total) FILTER (NOT valid), 0)::BIGINT AS reads_discarded, count(*) FILTER (NOT valid) AS molecules_discarded FROM judged GROUP BY seed, frac_idx)
  SELECT *, round(100 - 100 * molecules::DOUBLE / reads, 6) AS saturation FROM b""")
def bulk_saturation(spark, sf_dir):
    return summaries.bulk(judged(spark, sf_dir))


@query("class_totals", f"{JUDGED} SELECT seed, frac_idx, class, sum(total)::BIGINT AS reads, count(*) AS molecules FROM judged WHERE valid GROUP BY ALL")
def class_totals(spark, sf_dir):
    return summaries.by_class(judged(spark, sf_dir))


@query("rpm_hist", f"{JUDGED} SELECT seed, frac_idx, least(total, 4) AS bin, count(*) AS n FROM judged WHERE valid GROUP BY ALL")
def rpm_hist(spark, sf_dir):
    return summaries.reads_histogram(judged(spark, sf_dir), 4)


@query("rpm_hist_by_class", f"{JUDGED} SELECT seed, frac_idx, class, least(total, 50) AS bin, count(*) AS n FROM judged WHERE valid GROUP BY ALL")
def rpm_hist_by_class(spark, sf_dir):
    return summaries.reads_histogram(judged(spark, sf_dir).withColumn("class", summaries.molecule_class()), 50, "class")


@query("sample_stats", f"{JUDGED} SELECT frac_idx, 's' || (barcode % 3) AS sample, sum(total)::BIGINT AS reads, count(*) AS molecules, round(100 - 100 * count(*)::DOUBLE / sum(total), 6) AS saturation FROM judged WHERE valid GROUP BY ALL")
def sample_stats(spark, sf_dir):
    named = judged(spark, sf_dir).where("valid").withColumn("sample", F.concat(F.lit("s"), (F.col("barcode") % 3).cast("string")))
    return named.groupBy("frac_idx", "sample").agg(F.sum("total").alias("reads"), F.count(F.lit(1)).alias("molecules"), F.round(100 - 100 * F.count(F.lit(1)) / F.sum("total"), 6).alias("saturation"))


@query("barcode_stats", f"{JUDGED} SELECT seed, frac_idx, barcode, sum(total)::BIGINT AS reads, count(*) AS molecules, count(DISTINCT gene) AS genes FROM judged WHERE valid GROUP BY ALL")
def barcode_stats(spark, sf_dir):
    return summaries.barcode_stats(judged(spark, sf_dir))


@query("gene_masks_mt_mod", f"{JUDGED} SELECT frac_idx, barcode, count(*) FILTER (starts_with('g' || gene, 'g1')) AS mt_molecules, count(*) FILTER (gene IN (3, 7, 22)) AS module_molecules FROM judged WHERE valid GROUP BY ALL")
def gene_masks_mt_mod(spark, sf_dir):
    found = judged(spark, sf_dir)
    genes = fx.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).cast("long").alias("gene")).distinct()
    named = genes.select("gene", F.col("gene").cast("string").alias("gene_id"), F.concat(F.lit("g"), F.col("gene").cast("string")).alias("gene_name"))
    module = spark.createDataFrame([("3",), ("7",), ("22",)], "gene_id string")
    stats = summaries.barcode_classes(found, summaries.gene_masks(named, "g1", module_ids=module))
    return stats.select("frac_idx", "barcode", F.col("total_mt").alias("mt_molecules"), F.col("total_module").alias("module_molecules"))


CLASS_SUMS = ", ".join(
    f"coalesce(sum(total) FILTER ({t}), 0)::BIGINT AS {c}_reads, count(*) FILTER ({t}) AS {c}_molecules, count(DISTINCT gene) FILTER ({t}) AS {c}_genes, count(*) FILTER ({t} AND gene % 10 = 1) AS {c}_mt, count(*) FILTER ({t} AND gene IN (3, 7, 22)) AS {c}_module"
    for c, t in [("total", "true"), *((k, f"class = '{k}'") for k in thinning.CLASSES)]
)


def class_masks(spark, sf_dir):
    genes = fx.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).cast("long").alias("gene")).distinct()
    return genes.select("gene", (F.col("gene") % 10 == 1).alias("mt"), F.col("gene").isin(3, 7, 22).alias("module"))


@query("barcode_classes", f"{JUDGED} SELECT seed, frac_idx, barcode, {CLASS_SUMS} FROM judged WHERE valid GROUP BY ALL")
def barcode_classes(spark, sf_dir):
    return summaries.barcode_classes(judged(spark, sf_dir), class_masks(spark, sf_dir))


@query("exclude_genes", f"{JUDGED} SELECT frac_idx, coalesce(sum(total) FILTER (gene IN (1, 2, 3)), 0)::BIGINT AS reads_excluded, coalesce(sum(total) FILTER (gene NOT IN (1, 2, 3)), 0)::BIGINT AS reads FROM judged WHERE valid GROUP BY ALL")
def exclude_genes(spark, sf_dir):
    out = F.broadcast(spark.createDataFrame([(1,), (2,), (3,)], "gene long"))  # a given list
    found = judged(spark, sf_dir).where("valid")
    rest = summaries.bulk(found.join(out, "gene", "left_anti"))
    return summaries.with_excluded(rest, found.join(out, "gene", "left_semi")).select("frac_idx", "reads_excluded", "reads")


@query("total_matrix", f"{JUDGED} SELECT seed, frac_idx, barcode, gene, count(*) FILTER (valid) AS value FROM judged GROUP BY ALL")
def total_matrix(spark, sf_dir):
    return summaries.total_matrix(judged(spark, sf_dir))


@query("class_matrices", f"{JUDGED} SELECT seed, frac_idx, barcode, gene, class, count(*) AS value FROM judged WHERE valid GROUP BY ALL")
def class_matrices(spark, sf_dir):
    return summaries.class_matrices(judged(spark, sf_dir))


# --- spatial bins ------------------------------------------------------------


@query("visium_bins", f"""{SPOT_FULL}, pos AS ({fx.SPOTS_SQL}), placed AS (SELECT *, (array_row // 3) * 4 + array_col // 3 AS bin_idx FROM pos),
  t AS (SELECT bin_idx, count(*) AS n_barcodes, count(*) FILTER (in_tissue > 0) AS in_tissue FROM placed GROUP BY bin_idx),
  s AS (SELECT bin_idx, sum(total)::BIGINT AS reads, count(*) AS molecules, count(DISTINCT gene) AS genes FROM judged JOIN placed USING (barcode) WHERE valid GROUP BY bin_idx)
  SELECT g.bin_idx, coalesce(n_barcodes, 0) AS n_barcodes, coalesce(in_tissue, 0) AS in_tissue, coalesce(reads, 0) AS reads, coalesce(molecules, 0) AS molecules, coalesce(genes, 0) AS genes
  FROM (SELECT range AS bin_idx FROM range(0, 16)) g LEFT JOIN t USING (bin_idx) LEFT JOIN s USING (bin_idx)""")
def visium_bins(spark, sf_dir):
    return summaries.spatial_bins(spot_molecules(spark, sf_dir), fx.spots(spark, sf_dir), 10, 10, 3, 3)


@query("visium_bin_sums", f"""{SPOT_FULL}, pos AS ({fx.SPOTS_SQL}), placed AS (SELECT *, (array_row // 3) * 4 + array_col // 3 AS bin_idx FROM pos), n AS (SELECT spot AS barcode, count(*) AS countable FROM raw GROUP BY 1),
  b AS (SELECT barcode, sum(total) AS reads, count(*) AS molecules, count(*) FILTER (gene % 10 = 1) AS mt, count(*) FILTER (gene IN (3, 7, 22)) AS module FROM judged WHERE valid GROUP BY 1)
  SELECT g.bin_idx, count(p.barcode) AS n_barcodes, coalesce(sum(p.in_tissue), 0)::BIGINT AS in_tissue, coalesce(sum(countable), 0)::BIGINT AS countable, coalesce(sum(reads), 0)::BIGINT AS reads, coalesce(sum(molecules), 0)::BIGINT AS molecules, coalesce(sum(mt), 0)::BIGINT AS mt, coalesce(sum(module), 0)::BIGINT AS module
  FROM (SELECT range AS bin_idx FROM range(0, 16)) g LEFT JOIN placed p USING (bin_idx) LEFT JOIN b USING (barcode) LEFT JOIN n USING (barcode) GROUP BY g.bin_idx""")
def visium_bin_sums(spark, sf_dir):
    stats = summaries.barcode_classes(spot_molecules(spark, sf_dir), class_masks(spark, sf_dir))
    stats = stats.select("barcode", *[F.col(f"total_{c}").alias(c) for c in ("reads", "molecules", "mt", "module")])
    countable = fx.raw_tags(spark, sf_dir).groupBy(F.col("spot").alias("barcode")).agg(F.count(F.lit(1)).alias("countable"))
    places = fx.spots(spark, sf_dir).join(countable, "barcode", "left")
    return summaries.spatial_bin_sums(stats, places, 10, 10, 3, 3)


@query("bin_gene_counts", f"{SPOT_FULL}, pos AS ({fx.SPOTS_SQL}) SELECT (array_row // 2) * 5 + array_col // 2 AS bin_idx, gene, count(*) AS value FROM judged JOIN pos USING (barcode) WHERE valid GROUP BY ALL")
def bin_gene_counts(spark, sf_dir):
    placed = fx.spots(spark, sf_dir).select("barcode", (F.floor(F.col("array_row") / 2) * 5 + F.floor(F.col("array_col") / 2)).cast("long").alias("bin_idx"))
    return spot_molecules(spark, sf_dir).where("valid").join(placed, "barcode").groupBy("bin_idx", "gene").agg(F.count(F.lit(1)).alias("value"))


@query("bin_distinct_genes", f"{SPOT_FULL}, pos AS ({fx.SPOTS_SQL}) SELECT array_row // 2 AS row_bin, count(DISTINCT gene) AS genes FROM judged JOIN pos USING (barcode) WHERE valid AND in_tissue = 1 GROUP BY ALL")
def bin_distinct_genes(spark, sf_dir):
    placed = fx.spots(spark, sf_dir).where("in_tissue = 1").select("barcode", F.floor(F.col("array_row") / 2).cast("long").alias("row_bin"))
    return spot_molecules(spark, sf_dir).where("valid").join(placed, "barcode").groupBy("row_bin").agg(F.countDistinct("gene").alias("genes"))


# --- cells -------------------------------------------------------------------

CELLS = "cells AS (SELECT c_custkey AS barcode, CAST(floor(abs(c_acctbal)) AS BIGINT) AS molecules, CASE WHEN c_mktsegment <> 'BUILDING' THEN 1 ELSE 0 END AS is_cell FROM customer)"
PASSED = f"""{CELLS}, used AS (SELECT log10(molecules) AS x FROM cells WHERE is_cell > 0 AND molecules >= 500),
  m AS (SELECT median(x) AS med FROM used), d AS (SELECT med, median(abs(x - med)) AS mad FROM used, m GROUP BY med),
  f AS (SELECT barcode, molecules, is_cell, CASE WHEN is_cell > 0 AND molecules >= greatest(500.0, power(10.0, med - 2 * mad)) THEN 1 ELSE 0 END AS passed FROM cells, d)"""


def cell_table(spark, sf_dir):
    return fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("barcode"), F.floor(F.abs("c_acctbal")).cast("long").alias("molecules"), (F.col("c_mktsegment") != "BUILDING").cast("int").alias("is_cell"))


@query("mad_filter", f"WITH {PASSED} SELECT * FROM f")
def mad_filter(spark, sf_dir):
    return cells.mad_filter(cell_table(spark, sf_dir), 500, 2)


@query("filter_info", f"WITH {PASSED} SELECT count(*) AS total, sum(is_cell)::BIGINT AS called, sum(passed)::BIGINT AS passed, round(100.0 * sum(passed) / count(*), 6)::DOUBLE AS percent_kept, min(molecules) FILTER (passed = 1) AS least, max(molecules) FILTER (passed = 1) AS most FROM f")
def filter_info(spark, sf_dir):
    kept = F.when(F.col("passed") == 1, F.col("molecules"))
    return cells.mad_filter(cell_table(spark, sf_dir), 500, 2).agg(
        F.count(F.lit(1)).alias("total"), F.sum("is_cell").alias("called"), F.sum("passed").alias("passed"),
        F.round(100 * F.sum("passed") / F.count(F.lit(1)), 6).alias("percent_kept"), F.min(kept).alias("least"), F.max(kept).alias("most"),
    )


@query("annotate_left_join", "SELECT s_suppkey AS barcode, c_nationkey IS NOT NULL AS annotated, count(*) AS n FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey AND c_acctbal > 0 GROUP BY ALL")
def annotate_left_join(spark, sf_dir):
    meta = fx.table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("barcode"), "c_nationkey")
    codes = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("barcode"))
    return codes.join(meta, "barcode", "left").groupBy("barcode", F.col("c_nationkey").isNotNull().alias("annotated")).agg(F.count(F.lit(1)).alias("n"))


@query("bh_fdr", "WITH t AS (SELECT c_custkey AS id, (c_custkey * 7919 % 10000) / 10000.0::DOUBLE AS p FROM customer), r AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p) AS q FROM t) SELECT id, p, round(least(1.0::DOUBLE, min(q) OVER (ORDER BY p DESC)), 9) AS fdr FROM r")
def bh_fdr(spark, sf_dir):
    tests = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7919 % 10000 / 10000.0).alias("p"))
    return cells.benjamini_hochberg(tests).select("id", "p", F.round("fdr", 9).alias("fdr"))


# --- model -------------------------------------------------------------------

SIZE, R = 9777485.172692884, 2.6387012796186737


@query("saturation_curve_predict", f"SELECT o_orderkey AS id, round({SIZE} * (1 - power({R} / ({R} + reads / {SIZE}), {R})), 3) AS molecules, round(100 - 100 * {SIZE} * (1 - power({R} / ({R} + reads / {SIZE}), {R})) / reads, 6) AS saturation FROM (SELECT o_orderkey, o_orderkey * 1000.0::DOUBLE + 1 AS reads FROM orders)")
def saturation_curve_predict(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 1000.0 + 1).alias("reads"))
    seen = library.molecules(F.col("reads"), F.lit(SIZE), F.lit(R))
    return rows.select("id", F.round(seen, 3).alias("molecules"), F.round(library.saturation(F.col("reads"), seen), 6).alias("saturation"))


#: A library for each customer: its size, dispersion and rate of countable reads.
LIBRARIES_SQL = "lib AS (SELECT c_custkey AS id, 1000.37 + c_custkey * 997 % 100000::DOUBLE AS size, 0.5 + c_custkey % 9::DOUBLE AS r, 0.3 + c_custkey % 7 / 10.0::DOUBLE AS rate FROM customer)"


def library_rows(spark, sf_dir):
    key = F.col("c_custkey").cast("long")
    return fx.table(spark, sf_dir, "customer").select(key.alias("id"), (1000.37 + (key * 997 % 100000).cast("double")).alias("size"), (0.5 + key % 9).cast("double").alias("r"), (0.3 + key % 7 / 10.0).cast("double").alias("rate"))


@query("recovery_costs", f"""WITH {LIBRARIES_SQL}, c AS (SELECT id, size, r, rate, 10 + 5 * i::DOUBLE AS recovery FROM lib, range(18) t(i)), d AS (SELECT *, r * size * (power(1 - recovery / 100, -1 / r) - 1) AS reads FROM c),
  m AS (SELECT *, size * (1 - power(r / (r + reads / size), r)) AS seen FROM d)
  SELECT id, recovery, round(reads, 3) AS reads, CAST(round(seen) AS BIGINT) AS molecules, CAST(round(reads / rate) AS BIGINT) AS sequenced_reads, round(100 - 100 * seen / reads, 6) AS saturation FROM m""")
def recovery_costs(spark, sf_dir):
    found = fit_products.recovery_costs(library_rows(spark, sf_dir), 10, 95, 5)
    return found.select("id", "recovery", F.round("reads", 3).alias("reads"), "molecules", "sequenced_reads", F.round("saturation", 6).alias("saturation"))


@query("predict_pmf", f"WITH {LIBRARIES_SQL}, k AS (SELECT id, CAST(x AS BIGINT) AS bin, exp(lgamma(x + r) - lgamma(x + 1) - lgamma(r)) * power(0.3 + id % 5 / 10.0::DOUBLE, r) * power(1 - (0.3 + id % 5 / 10.0::DOUBLE), x) AS y FROM lib, range(1, 21) t(x)) SELECT id, bin, round(y / sum(y) OVER (PARTITION BY id), 9) AS share FROM k")
def predict_pmf(spark, sf_dir):
    fits = library_rows(spark, sf_dir).withColumns({"p": 0.3 + F.col("id") % 5 / 10.0, "molecules": F.lit(1000)})
    return fit_products.predicted_histogram(fits, 20).select("id", F.col("bin").cast("long").alias("bin"), F.round("share", 9).alias("share"))


@query("predict_errors", f"""WITH t AS (SELECT o_orderkey AS id, o_orderkey * 1000.0::DOUBLE + 1 AS reads, (o_orderkey * 1000.0::DOUBLE + 1) * 0.6 AS seen FROM orders),
  m AS (SELECT *, {SIZE} * (1 - power({R} / ({R} + reads / {SIZE}), {R})) AS molecules FROM t)
  SELECT id, round(100 * molecules / {SIZE}, 6) AS recovery, round(100 * abs(seen - molecules) / seen, 6) AS molecules_pdiff, round(abs(100 * seen / reads - 100 * molecules / reads), 6) AS saturation_err, round(abs(100 * seen / {SIZE} - 100 * molecules / {SIZE}), 6) AS recovery_err FROM m""")
def predict_errors(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 1000.0 + 1).alias("reads"), F.lit(SIZE).alias("size"), F.lit(R).alias("r"))
    found = curves.prediction_errors(rows.withColumn("seen", F.col("reads") * 0.6))
    return found.select("id", *[F.round(c, 6).alias(c) for c in ("recovery", "molecules_pdiff", "saturation_err", "recovery_err")])


@query("saturation_costs_bisection", f"WITH {LIBRARIES_SQL} SELECT id, 10 + 5 * i::DOUBLE AS saturation, 10 + 5 * i::DOUBLE AS reached, true AS priced FROM lib, range(18) t(i)")
def saturation_costs_bisection(spark, sf_dir):
    """Costs by inverting the model; the oracle says what saturation the model has at the reads that are found."""
    found = fit_products.saturation_costs(library_rows(spark, sf_dir), 10, 95, 5)
    reached = library.saturation(F.col("reads"), library.molecules(F.col("reads"), F.col("size"), F.col("r")))
    return found.select("id", "saturation", F.round(reached, 5).alias("reached"), (F.abs(F.col("sequenced_reads") * F.col("rate") - F.col("reads")) <= 1).alias("priced"))


@query("ks_distance", f"{FULL}, h AS (SELECT least(total, 50) AS bin, count(*) AS n FROM judged WHERE valid GROUP BY ALL), c AS (SELECT bin, sum(n) OVER (ORDER BY bin) / (SELECT sum(n) FROM h) AS observed, 1 - power(0.5, bin) AS model FROM h) SELECT round(max(abs(observed - model)), 9) AS ks FROM c")
def ks_distance(spark, sf_dir):
    hist = summaries.reads_histogram(judged(spark, sf_dir, [1.0]), 50)
    order = Window.orderBy("bin")  # at most 50 rows
    both = hist.withColumn("observed", F.sum("n").over(order) / F.sum("n").over(Window.partitionBy()))
    return both.agg(F.round(F.max(F.abs(F.col("observed") - (1 - F.pow(F.lit(0.5), F.col("bin"))))), 9).alias("ks"))


@query("pilot_grid", """WITH u AS (SELECT l_suppkey AS id, sum(l_partkey)::BIGINT AS countable, count(DISTINCT l_linenumber) AS units FROM lineitem GROUP BY 1)
  SELECT id, CAST(m * power(10, d) AS BIGINT) AS step, round(m * power(10, d) * units / countable, 9)::DOUBLE AS fraction FROM u, range(2, 7) a(d), (VALUES (1), (2), (5)) b(m) WHERE m * power(10, d) * units <= countable""")
def pilot_grid(spark, sf_dir):
    units = fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.sum("l_partkey").alias("countable"), F.countDistinct("l_linenumber").alias("units"))
    return curves.pilot_grid(units).select("id", "step", F.round("fraction", 9).alias("fraction"))


@query("interp_lookup", """WITH c AS (SELECT o_custkey AS x, count(*) AS y FROM orders GROUP BY 1), s AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS x2, lead(y) OVER (ORDER BY x) AS y2 FROM c),
  t AS (SELECT DISTINCT c_custkey AS q FROM customer) SELECT q, round(CAST(y + coalesce((log10(q + 1) - log10(x + 1)) / (log10(x2 + 1) - log10(x + 1)) * (y2 - y), 0) AS DOUBLE), 6) AS value FROM t JOIN s ON q >= x AND (q < x2 OR x2 IS NULL)""")
def interp_lookup(spark, sf_dir):
    curve = fx.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("x")).agg(F.count(F.lit(1)).alias("y"))
    asked = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("x"))
    found = interpolation.interpolated(curve, asked, lambda x: F.log10(x + 1)).where("y IS NOT NULL")
    return found.select(F.col("x").cast("long").alias("q"), F.round("y", 6).alias("value"))


@query("ztnb_fit")
def ztnb_fit(spark, sf_dir):
    hist = summaries.reads_histogram(judged(spark, sf_dir).withColumn("class", summaries.molecule_class()), 50, "class")
    return fitting.fit_histograms(hist, "frac_idx", "class")


@query("limit_errors", f"{JUDGED}, b AS (SELECT frac_idx, sum(total) AS reads, count(*) AS molecules FROM judged WHERE valid GROUP BY ALL) SELECT count(*) AS n, round(avg(abs(molecules - 20000.0 * (1 - power(2.0 / (2.0 + reads / 20000.0), 2.0)))), 6)::DOUBLE AS mae FROM b")
def limit_errors(spark, sf_dir):
    b = summaries.bulk(judged(spark, sf_dir)).select("reads", F.col("molecules").alias("seen"), F.lit(20000.0).alias("size"), F.lit(2.0).alias("r"))
    return curves.prediction_errors(b).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("molecules") - F.col("seen"))), 6).alias("mae"))


# --- overlap and stability ---------------------------------------------------

OVERLAP = f"""{TAGS}, {thin_sql([0.25, 0.5, 1.0], SEEDS)}, {COLLAPSE}, {VALID}, g AS (SELECT seed, frac_idx, barcode, gene, count(*) FILTER (valid) AS value FROM judged GROUP BY ALL),
  base AS (SELECT barcode, gene, value FROM g WHERE frac_idx = 2 AND seed = {SEEDS[0]}),
  z AS (SELECT barcode, count(*) AS b, count(*) FILTER (value = 1) AS b1, count(*) FILTER (value = 2) AS b2, count(*) FILTER (value >= 3) AS b3p FROM base GROUP BY barcode),
  o AS (SELECT g.seed, g.frac_idx, g.barcode, count(*) AS shared FROM g JOIN base USING (barcode, gene) WHERE g.value > 0 AND frac_idx < 2 GROUP BY ALL),
  r AS (SELECT seed, frac_idx, barcode, shared, b, b1, b2, b3p, round(shared::DOUBLE / b, 6) AS stability FROM o JOIN z USING (barcode))"""


def overlap(spark, sf_dir):
    matrix = summaries.total_matrix(judged(spark, sf_dir, [0.25, 0.5, 1.0], SEEDS))
    return stability.gene_overlap(matrix.where((F.col("frac_idx") == 2) & (F.col("seed") == SEEDS[0])).select("barcode", "gene", "value"), matrix.where("frac_idx < 2"))


@query("gene_overlap_counts", f"{OVERLAP} SELECT * FROM r")
def gene_overlap_counts(spark, sf_dir):
    return overlap(spark, sf_dir)


@query("gene_overlap_stability", f"{OVERLAP} SELECT frac_idx, barcode, round(avg(stability), 5) AS stability FROM r GROUP BY ALL")
def gene_overlap_stability(spark, sf_dir):
    return overlap(spark, sf_dir).groupBy("frac_idx", "barcode").agg(F.round(F.avg("stability"), 5).alias("stability"))


@query("gene_stability_summary", f"{OVERLAP} SELECT frac_idx, round(median(stability), 6) AS median_stability, min(b) AS least_genes, count(*) AS n FROM r GROUP BY ALL")
def gene_stability_summary(spark, sf_dir):
    return overlap(spark, sf_dir).groupBy("frac_idx").agg(F.round(F.median("stability"), 6).alias("median_stability"), F.min("b").alias("least_genes"), F.count(F.lit(1)).alias("n"))


GENE_CLASSES = f"""{OVERLAP}, hit AS (SELECT g.frac_idx, g.barcode, count(*) AS shared, count(*) FILTER (base.value = 1) AS shared_1, count(*) FILTER (base.value = 2) AS shared_2, count(*) FILTER (base.value >= 3) AS shared_3p
    FROM g JOIN base USING (barcode, gene) WHERE g.value > 0 AND base.value > 0 AND g.frac_idx < 2 GROUP BY ALL),
  own AS (SELECT barcode, count(*) AS counts, count(*) FILTER (value = 1) AS counts_1, count(*) FILTER (value = 2) AS counts_2, count(*) FILTER (value >= 3) AS counts_3p FROM base WHERE value > 0 GROUP BY barcode),
  c AS (SELECT f.frac_idx, own.*, """ + ", ".join(f"CASE WHEN counts{x} > 0 THEN coalesce(shared{x}, 0)::DOUBLE / (counts{x} * {len(SEEDS)}) ELSE 0 END AS stability{x}" for x in stability.GENE_CLASSES) + """
    FROM own CROSS JOIN (VALUES (0), (1)) f(frac_idx) LEFT JOIN hit ON hit.barcode = own.barcode AND hit.frac_idx = f.frac_idx)"""


def gene_classes(spark, sf_dir):
    matrix = kept(summaries.total_matrix(judged(spark, sf_dir, [0.25, 0.5, 1.0], SEEDS)))
    own = matrix.where((F.col("frac_idx") == 2) & (F.col("seed") == SEEDS[0]))
    return stability.gene_class_stability(own, matrix.where("frac_idx < 2"), len(SEEDS), 2)


@query("gene_class_stability", f"{GENE_CLASSES} SELECT frac_idx, barcode, counts, counts_1, counts_2, counts_3p, " + ", ".join(f"round(stability{x}, 6) AS stability{x}" for x in stability.GENE_CLASSES) + " FROM c")
def gene_class_stability(spark, sf_dir):
    return gene_classes(spark, sf_dir).withColumns({f"stability{x}": F.round(f"stability{x}", 6) for x in stability.GENE_CLASSES})


@query("gene_class_summary", f"{GENE_CLASSES} SELECT frac_idx, " + ", ".join(
    f"count(*) FILTER (counts{x} >= 3) AS counts{x}, round(100.0 * count(*) FILTER (counts{x} >= 3) / count(*), 6)::DOUBLE AS fracs{x}, round(median(stability{x}) FILTER (counts{x} >= 3), 6) AS median_stability{x}, round(median(counts{x}), 6)::DOUBLE AS genes{x}"
    + (f", round(100 * median(counts{x}::DOUBLE / counts), 6) AS fgenes{x}" if x else "") for x in stability.GENE_CLASSES) + " FROM c GROUP BY frac_idx")
def gene_class_summary(spark, sf_dir):
    found = stability.gene_class_summary(gene_classes(spark, sf_dir), 3)
    return found.select(*[F.round(c, 6).alias(c) if kind == "double" else c for c, kind in found.dtypes])


@query("ari", "WITH t AS (SELECT label, vec_id % 10 AS other, count(*) AS n FROM embeddings GROUP BY ALL), x AS (SELECT sum(n * (n - 1) / 2.0) AS both_in, sum(n) AS n FROM t), a AS (SELECT sum(n * (n - 1) / 2.0) AS s FROM (SELECT sum(n) AS n FROM t GROUP BY label)), b AS (SELECT sum(n * (n - 1) / 2.0) AS s FROM (SELECT sum(n) AS n FROM t GROUP BY other)) SELECT round((both_in - a.s * b.s / (n * (n - 1) / 2.0)) / ((a.s + b.s) / 2 - a.s * b.s / (n * (n - 1) / 2.0)), 9) AS ari FROM x, a, b")
def ari(spark, sf_dir):
    labels = fx.table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 10).alias("other"))
    return stability.adjusted_rand(labels, "label", "other").select(F.round("ari", 9).alias("ari"))


@query("hvg_jaccard", "WITH s AS (SELECT DISTINCT l_suppkey % 20 AS k, l_partkey % 9973 AS i FROM lineitem), n AS (SELECT k, count(*) AS n FROM s GROUP BY k), h AS (SELECT x.k AS a, y.k AS b, count(*) AS shared FROM s x JOIN s y ON x.i = y.i AND x.k < y.k GROUP BY ALL) SELECT p.k AS a, q.k AS b, round(coalesce(shared, 0)::DOUBLE / (p.n + q.n - coalesce(shared, 0)), 6) AS jaccard FROM n p JOIN n q ON p.k < q.k LEFT JOIN h ON h.a = p.k AND h.b = q.k")
def hvg_jaccard(spark, sf_dir):
    sets = fx.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("k"), (F.col("l_partkey") % 9973).alias("i"))
    return stability.jaccard(sets, "k", "i")


KNN = "d AS (SELECT a.vec_id AS id, b.vec_id AS other, list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))) AS d2 FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id), k AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY d2, other) AS place FROM d QUALIFY place <= 10)"


def neighbours(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings")
    return stability.nearest(rows.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vec")), 10)


@query("knn_topk", f"WITH {KNN} SELECT id, other, CAST(place AS INTEGER) AS place FROM k")
def knn_topk(spark, sf_dir):
    return neighbours(spark, sf_dir).select("id", "other", "place")


def by_lists(spark, sf_dir, **options):
    rows = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vec"))
    return lists.near_neighbours(rows, 10, list_rows=256, **options)


@query("knn_by_lists", f"WITH {KNN} SELECT id, other, CAST(place AS INTEGER) AS place FROM k")
def knn_by_lists(spark, sf_dir):
    """Every row looks at every list, so the result is exact."""
    return by_lists(spark, sf_dir, probes=lists.MAX_LISTS).select("id", "other", "place")


@query("knn_recall")
def knn_recall(spark, sf_dir):
    """The share of exact neighbours that lists give, as many as hold 0.95 of those of the rows asked."""
    return lists.recall_of(by_lists(spark, sf_dir, recall=0.95), neighbours(spark, sf_dir))


@query("knn_label_agreement", f"WITH {KNN} SELECT x.label, count(*) AS n, count(*) FILTER (x.label = y.label) AS agree FROM k JOIN embeddings x ON x.vec_id = id JOIN embeddings y ON y.vec_id = other GROUP BY ALL")
def knn_label_agreement(spark, sf_dir):
    labels = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    pairs = neighbours(spark, sf_dir).join(labels, "id").join(labels.toDF("other", "other_label"), "other")
    return pairs.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("other_label")).alias("agree"))


@query("log_normalise", f"{FULL}, g AS (SELECT barcode, gene, count(*) AS value FROM judged WHERE valid GROUP BY ALL) SELECT barcode, gene, round(ln(1 + value * 10000.0::DOUBLE / sum(value) OVER (PARTITION BY barcode)), 9) AS x FROM g")
def log_normalise(spark, sf_dir):
    counts = summaries.total_matrix(judged(spark, sf_dir, [1.0])).where("value > 0")
    return stability.log_normalised(counts).select("barcode", "gene", F.round("x", 9).alias("x"))


@query("filter_genes_min_cells", f"{FULL} SELECT gene, count(DISTINCT barcode) AS cells FROM judged WHERE valid GROUP BY gene HAVING count(DISTINCT barcode) >= 10")
def filter_genes_min_cells(spark, sf_dir):
    return judged(spark, sf_dir, [1.0]).where("valid").groupBy("gene").agg(F.countDistinct("barcode").alias("cells")).where("cells >= 10")


# --- annotation --------------------------------------------------------------

GENES_SQL = "genes AS (SELECT p_partkey AS gene, p_partkey % 5 AS chrom, p_partkey * 40 AS gene_lft, p_partkey * 40 + p_size * 20 AS gene_rgt, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS gene_strand, p_partkey * 40 + p_size * 20 // 3 AS e1, p_partkey * 40 + p_size * 40 // 3 AS e2 FROM part)"
READS_SQL = """reads AS (SELECT concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT), l_returnflag, l_linestatus, CAST(round(l_extendedprice * 100) AS BIGINT)) AS read_id,
  l_partkey % 5 AS chrom, l_partkey * 40 + l_orderkey % 400 AS lft, l_partkey * 40 + l_orderkey % 400 + 59 + CAST(l_quantity AS BIGINT) AS rgt FROM lineitem)"""


def genes(spark, sf_dir):
    key, size = F.col("p_partkey").cast("long"), F.col("p_size").cast("long")
    lft = key * 40
    exon = lambda a, b: F.struct(a.cast("long").alias("lft"), b.cast("long").alias("rgt"))
    e1, e2 = lft + F.floor(size * 20 / 3), lft + F.floor(size * 40 / 3)
    return fx.table(spark, sf_dir, "part").select(
        key.alias("gene"), (key % 5).alias("chrom"), lft.alias("lft"), (lft + size * 20).alias("rgt"), F.when(key % 2 == 0, "+").otherwise("-").alias("gene_strand"),
        F.array(exon(lft, e1), exon(e2, lft + size * 20)).alias("exons"), F.array(exon(e1, e2)).alias("junctions"),
    )


def reads(spark, sf_dir, spliced: bool = False):
    cigar = "concat(60 + cast(l_quantity as long), 'M')"
    if spliced:
        cigar = f"CASE WHEN l_linenumber % 3 = 0 THEN '40M100N40M' WHEN l_linenumber % 3 = 1 THEN concat('3S', {cigar}, '2I5M1D4M') ELSE {cigar} END"
    rows = fx.table(spark, sf_dir, "lineitem").selectExpr(
        "concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(l_quantity as long), l_returnflag, l_linestatus, cast(round(l_extendedprice * 100) as long)) AS read_id",
        "cast(l_partkey % 5 as long) AS chrom", "cast(l_partkey * 40 + l_orderkey % 400 as long) AS pos", f"{cigar} AS cigar", "CASE WHEN l_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand",
    )
    return annotate.with_blocks(rows)


@query("range_join", f"WITH {GENES_SQL}, {READS_SQL} SELECT gene, count(*) AS hits FROM reads JOIN genes ON reads.chrom = genes.chrom AND gene_lft < rgt AND lft < gene_rgt GROUP BY gene")
def range_join(spark, sf_dir):
    # What goes through Arrow isn't pruned, so columns are chosen first.
    return annotate.range_join(reads(spark, sf_dir).select("chrom", "lft", "rgt"), genes(spark, sf_dir).select("gene", "chrom", "lft", "rgt")).groupBy("gene").agg(F.count(F.lit(1)).alias("hits"))


@query("cigar_blocks", """WITH r AS (SELECT CAST(l_linenumber % 3 AS BIGINT) AS kind, l_partkey * 40 + l_orderkey % 400 AS pos, 60 + CAST(l_quantity AS BIGINT) AS n FROM lineitem)
  SELECT kind, count(*) AS n_reads, sum(CASE WHEN kind = 0 THEN 2 ELSE 1 END)::BIGINT AS n_blocks, sum(CASE kind WHEN 0 THEN 80 WHEN 1 THEN n + 10 ELSE n END)::BIGINT AS bases, sum(CASE kind WHEN 0 THEN pos + 179 WHEN 1 THEN pos + n + 9 ELSE pos + n - 1 END)::BIGINT AS ends FROM r GROUP BY kind""")
def cigar_blocks(spark, sf_dir):
    kind = F.when(F.col("cigar").contains("N"), 0).when(F.col("cigar").startswith("3S"), 1).otherwise(2).cast("long")
    return reads(spark, sf_dir, spliced=True).groupBy(kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("n_reads"), F.sum(F.size("blocks")).alias("n_blocks"), F.sum(F.expr("aggregate(blocks, 0L, (n, b) -> n + b.rgt - b.lft + 1)")).alias("bases"), F.sum("rgt").alias("ends")
    )


VOTES_SQL = f"""WITH {GENES_SQL}, {READS_SQL}, h AS (
  SELECT read_id, gene, rgt - lft + 1 AS bases, least(rgt, gene_rgt) - greatest(lft, gene_lft) + 1 AS inside,
         greatest(0, least(rgt, e1) - greatest(lft, gene_lft) + 1) + greatest(0, least(rgt, gene_rgt) - greatest(lft, e2) + 1) AS exonic
  FROM reads JOIN genes ON reads.chrom = genes.chrom AND gene_lft < rgt AND lft < gene_rgt
  WHERE gene_strand = CASE WHEN CAST(split_part(read_id, '|', 2) AS BIGINT) % 2 = 0 THEN '+' ELSE '-' END
), v AS (
  SELECT read_id, gene, CASE WHEN inside - exonic >= 15 THEN 'unspliced' WHEN exonic::DOUBLE / inside >= 0.95 THEN 'ambiguous' ELSE 'none' END AS vote
  FROM h WHERE inside >= 40 AND inside::DOUBLE / bases >= 0.95
), c AS (
  SELECT read_id, count(*) FILTER (vote = 'ambiguous') AS e, count(*) FILTER (vote = 'unspliced') AS u, max(gene) FILTER (vote = 'ambiguous') AS ge, max(gene) FILTER (vote = 'unspliced') AS gu FROM v GROUP BY read_id
), r AS (SELECT read_id, CASE WHEN e = 1 THEN ge WHEN e = 0 AND u = 1 THEN gu END AS gene, CASE WHEN e = 1 THEN 'ambiguous' WHEN e = 0 AND u = 1 THEN 'unspliced' ELSE 'no_gene' END AS class FROM c)"""


@query("read_class_vote", f"{VOTES_SQL} SELECT gene, class, count(*) AS n FROM r GROUP BY ALL")
def read_class_vote(spark, sf_dir):
    found = annotate.classified(reads(spark, sf_dir).select("read_id", "chrom", "pos", "cigar", "strand"), genes(spark, sf_dir), "read_id").where("held_by > 0")
    return found.groupBy("gene", "class").agg(F.count(F.lit(1)).alias("n"))


SPLICED_SQL = f"""WITH {GENES_SQL}, t AS (
  SELECT row_number() OVER () AS id, l_partkey % 5 AS chrom, CASE WHEN l_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, l_partkey * 40 + l_orderkey % 400 AS pos, l_linenumber % 3 AS kind, 60 + CAST(l_quantity AS BIGINT) AS m FROM lineitem
), b AS (
  SELECT *, unnest(CASE kind WHEN 0 THEN [{{'a': pos, 'z': pos + 39}}, {{'a': pos + 140, 'z': pos + 179}}] WHEN 1 THEN [{{'a': pos, 'z': pos + m + 9}}] ELSE [{{'a': pos, 'z': pos + m - 1}}] END) AS x FROM t
), h AS (
  SELECT id, gene, kind = 0 AS two, sum(x.z - x.a + 1) AS bases, min(least(x.z, gene_rgt) - greatest(x.a, gene_lft) + 1) AS narrowest, sum(greatest(0, least(x.z, gene_rgt) - greatest(x.a, gene_lft) + 1)) AS inside,
         sum(greatest(0, least(x.z, e1) - greatest(x.a, gene_lft) + 1) + greatest(0, least(x.z, gene_rgt) - greatest(x.a, e2) + 1)) AS exonic,
         bool_or(kind = 0 AND pos + 39 = e1 AND pos + 140 = e2) AS known
  FROM b JOIN genes ON b.chrom = genes.chrom AND gene_lft < pos + CASE kind WHEN 0 THEN 179 WHEN 1 THEN m + 9 ELSE m - 1 END AND pos < gene_rgt AND gene_strand = strand GROUP BY ALL
), v AS (
  SELECT id, gene, CASE WHEN inside - exonic >= 15 AND NOT two THEN 'unspliced' WHEN exonic::DOUBLE / inside >= 0.95 THEN CASE WHEN known THEN 'spliced' ELSE 'ambiguous' END ELSE 'none' END AS vote
  FROM h WHERE narrowest > 0 AND inside >= 40 AND inside::DOUBLE / bases >= 0.95
), c AS (
  SELECT id, count(*) FILTER (vote IN ('spliced', 'ambiguous')) AS e, count(*) FILTER (vote = 'unspliced') AS u, max(vote) FILTER (vote IN ('spliced', 'ambiguous')) AS ve, max(gene) FILTER (vote IN ('spliced', 'ambiguous')) AS ge, max(gene) FILTER (vote = 'unspliced') AS gu FROM v GROUP BY id
)
SELECT CASE WHEN e = 1 THEN ve WHEN e = 0 AND u = 1 THEN 'unspliced' ELSE 'no_gene' END AS class, count(*) AS n, sum(CASE WHEN e = 1 THEN ge WHEN e = 0 AND u = 1 THEN gu END)::BIGINT AS gene_sum FROM c GROUP BY 1"""


@query("spliced_reads", SPLICED_SQL)
def spliced_reads(spark, sf_dir):
    found = annotate.classified(reads(spark, sf_dir, spliced=True), genes(spark, sf_dir), "read_id").where("held_by > 0")
    return found.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("gene").alias("gene_sum"))


@query("spliced_reads_by_bins", SPLICED_SQL)
def spliced_reads_by_bins(spark, sf_dir):
    """spliced_reads as it runs where genes are too many for an index."""
    numbered = kept(reads(spark, sf_dir, spliced=True).withColumn("read_id", F.monotonically_increasing_id()))
    found = annotate.classified(numbered, genes(spark, sf_dir), "read_id", max_genes=0).where("held_by > 0")
    return found.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("gene").alias("gene_sum"))


EXONS_SQL = "exons AS (SELECT DISTINCT ps AS transcript, ps % 7 AS gene, CAST(q * 30 AS BIGINT) AS lft, CAST(q * 30 + 20 + ps % 40 AS BIGINT) AS rgt FROM (SELECT l_suppkey AS ps, CAST(l_quantity AS BIGINT) AS q FROM lineitem))"


def exons(spark, sf_dir):
    return fx.table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS transcript", "l_suppkey % 7 AS gene", "cast(l_quantity as long) * 30 AS lft", "cast(l_quantity as long) * 30 + 20 + l_suppkey % 40 AS rgt").distinct()


@query("junctions", f"WITH {EXONS_SQL} SELECT * FROM (SELECT transcript, lag(rgt) OVER (PARTITION BY transcript ORDER BY lft, rgt) AS lft, lft AS rgt FROM exons) WHERE lft IS NOT NULL")
def junctions(spark, sf_dir):
    return annotate.junctions(exons(spark, sf_dir))


@query("exon_merge", f"WITH {EXONS_SQL}, p AS (SELECT *, max(rgt) OVER (PARTITION BY gene ORDER BY lft, rgt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM (SELECT DISTINCT gene, lft, rgt FROM exons)), i AS (SELECT *, sum(CASE WHEN past IS NULL OR lft > past THEN 1 ELSE 0 END) OVER (PARTITION BY gene ORDER BY lft, rgt ROWS UNBOUNDED PRECEDING) AS island FROM p) SELECT gene, min(lft) AS lft, max(rgt) AS rgt FROM i GROUP BY gene, island")
def exon_merge(spark, sf_dir):
    return annotate.merged_exons(exons(spark, sf_dir).select("gene", "lft", "rgt").distinct())


@query("gene_breaks", "WITH g AS (SELECT p_partkey % 50 AS chrom, p_partkey * 40 AS lft, p_partkey * 40 + p_size * 20 AS rgt FROM part), p AS (SELECT *, max(rgt) OVER (PARTITION BY chrom ORDER BY lft, rgt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM g) SELECT chrom, past + 250 AS at FROM p WHERE lft - past > 500")
def gene_breaks(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "part").selectExpr("p_partkey % 50 AS chrom", "p_partkey * 40 AS lft", "p_partkey * 40 + p_size * 20 AS rgt")
    return annotate.gene_breaks(rows, 500)


@query("gtf_attributes", """WITH a AS (SELECT 'gene_id "G' || p_partkey || '"; ' || CASE WHEN p_size % 3 = 0 THEN '' ELSE 'gene_name "' || p_brand || '"; ' END || 'level 2;' AS attrs FROM part), x AS (SELECT regexp_extract(attrs, 'gene_id\\s+"?([^;"]+)"?;', 1) AS gene_id, regexp_extract(attrs, 'gene_name\\s+"?([^;"]+)"?;', 1) AS n FROM a) SELECT gene_id, coalesce(nullif(n, ''), gene_id) AS gene_name FROM x""".replace("\\\\", "\\"))
def gtf_attributes(spark, sf_dir):
    from ..sources.files import gtf_fields

    attrs = fx.table(spark, sf_dir, "part").select(F.expr("""concat('gene_id "G', p_partkey, '"; ', CASE WHEN p_size % 3 = 0 THEN '' ELSE concat('gene_name "', p_brand, '"; ') END, 'level 2;') AS attributes"""))
    return attrs.select(*gtf_fields("attributes", "gene_id", "gene_name"))


@query("probe_gene_assign", "SELECT CASE WHEN p_size % 4 = 0 OR p_size % 7 = 0 THEN 'no_gene' ELSE 'countable' END AS status, count(*) AS n FROM part GROUP BY 1")
def probe_gene_assign(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part")
    known = part.where("p_size % 4 <> 0").select(F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("gx"), F.col("p_partkey").alias("gene"))
    probed = part.select(F.expr("CASE WHEN p_size % 7 = 0 THEN concat('G', p_partkey, ';G1') ELSE concat('G', p_partkey) END").alias("gx")).join(known, "gx", "left")
    return probed.groupBy(F.when(F.col("gx").contains(";") | F.col("gene").isNull(), "no_gene").otherwise("countable").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("probe_exclude_list", "SELECT DISTINCT replace(split_part(CASE WHEN p_size % 7 = 0 THEN 'DEPRECATED_' ELSE '' END || p_brand || '|' || p_partkey, '|', 1), 'DEPRECATED_', '') AS gene_id FROM part WHERE p_size % 5 = 0")
def probe_exclude_list(spark, sf_dir):
    from ..sources.files import excluded_probes

    probes = fx.table(spark, sf_dir, "part").select(F.expr("concat(CASE WHEN p_size % 7 = 0 THEN 'DEPRECATED_' ELSE '' END, p_brand, '|', p_partkey)").alias("probe_id"), (F.col("p_size") % 5 != 0).alias("included"))
    return excluded_probes(probes)


NAMED = ", ".join(f"({i}, '{name}', {'NULL' if spec[libraries.FIELDS.index('UR_length')] is None else spec[libraries.FIELDS.index('UR_length')]})" for i, (name, spec) in enumerate(sorted(libraries.BUILT_IN.items())))


@query("library_catalogue", f"SELECT name, umi_length::INTEGER AS umi_length, count(*) AS reads FROM lineitem JOIN (VALUES {NAMED}) l(i, name, umi_length) ON i = l_suppkey % {len(libraries.BUILT_IN)} GROUP BY ALL")
def library_catalogue(spark, sf_dir):
    """Reads of lineitem by the library that each is taken to be of."""
    names = {i: name for i, name in enumerate(sorted(libraries.BUILT_IN))}
    named = fx.table(spark, sf_dir, "lineitem").select(F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), (F.col("l_suppkey") % len(names)).cast("int")).alias("name"))
    known = F.broadcast(libraries.catalogue(spark).withColumnRenamed(libraries.SPEC.split()[0], "name"))  # twelve rows
    return named.join(known, "name").groupBy("name", F.col("UR_length").cast("int").alias("umi_length")).agg(F.count(F.lit(1)).alias("reads"))


# --- binary sources ----------------------------------------------------------

CHROMS = [(f"chr{i}", 10**9) for i in range(5)]


@query("bam_scan", """WITH r AS (SELECT CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE 'chr' || (l_partkey % 5) END AS chrom, CASE WHEN l_orderkey % 13 = 0 THEN 4 WHEN l_partkey % 2 = 0 THEN 0 ELSE 16 END AS flag,
  CASE WHEN l_orderkey % 13 = 0 THEN -1 ELSE l_partkey * 40 + l_orderkey % 400 END AS pos, CAST(l_quantity AS BIGINT) AS mapq, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_suppkey END AS cb FROM lineitem)
  SELECT chrom, flag, count(*) AS n, sum(pos)::BIGINT AS pos_sum, sum(mapq)::BIGINT AS mapq_sum, sum(60 + mapq)::BIGINT AS bases, count(DISTINCT cb) AS barcodes, count(cb) AS with_barcode FROM r GROUP BY chrom, flag""")
def bam_scan(spark, sf_dir):
    """The reads of lineitem, written as BAM files by Spark and read back in splits."""
    reads = fx.table(spark, sf_dir, "lineitem").selectExpr(
        "concat_ws(':', l_orderkey, l_linenumber, l_partkey) AS qname", "CASE WHEN l_orderkey % 13 = 0 THEN 4 WHEN l_partkey % 2 = 0 THEN 0 ELSE 16 END AS flag",
        "CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE concat('chr', l_partkey % 5) END AS chrom", "CASE WHEN l_orderkey % 13 = 0 THEN -1L ELSE l_partkey * 40L + l_orderkey % 400 END AS pos",
        "cast(l_quantity as int) AS mapq", "concat('20M100N', 40 + cast(l_quantity as int), 'M') AS cigar",
        "CASE WHEN l_linenumber = 7 THEN NULL ELSE cast(l_suppkey as string) END AS cb", "cast(l_partkey as string) AS umi", "cast(NULL as string) AS gx",
    )
    path = scratch(spark, "bam")
    binary.write_bam(reads, path, CHROMS)
    found = binary.read_bam(spark, path)
    bases = F.expr("aggregate(regexp_extract_all(cigar, '([0-9]+)M', 1), 0L, (n, m) -> n + cast(m as long))")
    return found.groupBy("chrom", "flag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos_sum"), F.sum(F.col("mapq").cast("long")).alias("mapq_sum"),
        F.sum(bases).alias("bases"), F.countDistinct("cb").alias("barcodes"), F.count("cb").alias("with_barcode"),
    )


@query("tag_file_scan", f"{TAGS} SELECT barcode, count(*) AS tags, count(DISTINCT gene) AS genes, sum(umi)::BIGINT AS umi_sum, sum(spliced)::BIGINT AS spliced, sum(unspliced)::BIGINT AS unspliced, sum(ambiguous)::BIGINT AS ambiguous FROM tags GROUP BY barcode")
def tag_file_scan(spark, sf_dir):
    """The molecule table, written as binary tag files by Spark and read back in splits."""
    path = scratch(spark, "tags")
    binary.write_tag_file(fx.tags(spark, sf_dir).withColumn("flags", F.lit(0)), path)
    found = binary.read_tag_file(spark, path)
    return found.groupBy("barcode").agg(F.count(F.lit(1)).alias("tags"), F.countDistinct("gene").alias("genes"), F.sum("umi").alias("umi_sum"), *[F.sum(c).alias(c) for c in thinning.CLASSES])


# --- curves, replicates and streams ------------------------------------------


@query("rpm_hist_by_sample", f"{JUDGED} SELECT seed, frac_idx, 's' || (barcode % 3) AS sample, least(total, 50) AS bin, count(*) AS n FROM judged WHERE valid GROUP BY ALL")
def rpm_hist_by_sample(spark, sf_dir):
    named = judged(spark, sf_dir).withColumn("sample", F.concat(F.lit("s"), (F.col("barcode") % 3).cast("string")))
    return summaries.reads_histogram(named, 50, "sample")


@query("limit_fits")
def limit_fits(spark, sf_dir):
    found = kept(judged(spark, sf_dir, FRACS, SEEDS).select("seed", "frac_idx", "total", "valid"))
    totals = summaries.bulk(found)
    return curves.limit_errors(totals, summaries.reads_histogram(found, curves.BINS), totals)


LIMITS = [(20.0, 0.25), (30.0, 0.5), (40.0, 1.0)]
LIMIT_MOLECULES = f"{TAGS}, {thin_sql([f for _, f in LIMITS], SEEDS)}, {COLLAPSE}, {VALID}"
LIMIT_KEYS = "JOIN (VALUES " + ", ".join(f"({i}, {at}::DOUBLE, {f}::DOUBLE)" for i, (at, f) in enumerate(LIMITS)) + ") l(frac_idx, \"limit\", fraction) USING (frac_idx) JOIN (VALUES " + ", ".join(f"({s}::BIGINT, {i})" for i, s in enumerate(SEEDS)) + ") w(seed, curve_index) USING (seed)"


def limit_tables(spark, sf_dir):
    countable = fx.raw_tags(spark, sf_dir).count()
    return limits.products(lambda fracs: judged(spark, sf_dir, fracs, SEEDS), SEEDS, LIMITS, countable)[0]


@query("limit_stats", f"""{LIMIT_MOLECULES}, b AS (SELECT seed, frac_idx, coalesce(sum(total) FILTER (valid), 0)::BIGINT AS reads, count(*) FILTER (valid) AS molecules, coalesce(sum(total) FILTER (NOT valid), 0)::BIGINT AS reads_discarded, count(*) FILTER (NOT valid) AS molecules_discarded,
  {", ".join(f"coalesce(sum(total) FILTER (valid AND class = '{c}'), 0)::BIGINT AS {c}_reads, count(*) FILTER (valid AND class = '{c}') AS {c}_molecules" for c in thinning.CLASSES)} FROM judged GROUP BY ALL)
  SELECT b.*, round(100 - 100.0 * molecules / reads, 6)::DOUBLE AS saturation, round((reads + reads_discarded)::DOUBLE / (SELECT count(*) FROM raw), 9) AS downsampled_frac, "limit", fraction, curve_index FROM b {LIMIT_KEYS}""")
def limit_stats(spark, sf_dir):
    return limit_tables(spark, sf_dir).stats.drop("unit").withColumn("downsampled_frac", F.round("downsampled_frac", 9))


@query("limit_histograms", f"""{LIMIT_MOLECULES}, h AS (SELECT seed, frac_idx, total AS bin, count(*) AS n FROM judged WHERE valid AND total < 50 GROUP BY ALL)
  SELECT k.seed, k.curve_index, k.frac_idx, k.bin, coalesce(h.n, 0) AS n FROM (SELECT seed, curve_index, frac_idx, b::INTEGER AS bin FROM range(1, 50) r(b), (SELECT DISTINCT seed, frac_idx FROM judged) {LIMIT_KEYS}) k LEFT JOIN h USING (seed, frac_idx, bin)""")
def limit_histograms(spark, sf_dir):
    return limit_tables(spark, sf_dir).histograms


def deep_library(spark, sf_dir):
    """A library of many reads a molecule, unevenly spread: every row of lineitem is a tag, its quantity the reads."""
    kind = F.col("l_linenumber") % 3
    rows = fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("long").alias("barcode"), F.col("l_partkey").cast("long").alias("gene"), ((F.col("l_orderkey").cast("long") * 8 + F.col("l_linenumber")) % 4**fx.UMI_LENGTH).alias("umi"),
        *[F.when(kind == i, F.col("l_quantity").cast("long")).otherwise(0).alias(c) for i, c in enumerate(thinning.CLASSES)],
    )
    return Depth(rows, fx.UMI_LENGTH)


def deep_limits(spark, sf_dir, cells=None):
    """Limits every 10 % of saturation, by a fit of a tenth of the reads, up to the saturation of a fifth."""
    whole = deep_library(spark, sf_dir)
    countable = whole.tags.agg(F.sum(F.expr("spliced + unspliced + ambiguous"))).first()[0] or 1
    at = kept(summaries.tally(whole.downsample([0.1, 0.2]).tallies))
    totals = kept(summaries.bulk(at))
    low = F.col("frac_idx") == 0
    fit = kept(fit_products.sized(fitting.fit_histograms(summaries.reads_histogram(at.where(low), 50), "seed", "frac_idx").join(totals, ["seed", "frac_idx"])))
    asked = limits.saturation_limits(fit, countable, totals.where(~low).first()["saturation"], 10, 10)
    pilot = None if cells is None else limits.Pilot(countable, cells, decades=(1, 3))
    return limits.products(lambda fracs: whole.downsample(fracs, SEEDS).tallies, SEEDS, asked or [(None, 0.1), (None, 0.2)], countable, pilot=pilot)


@query("limit_medians")
def limit_medians(spark, sf_dir):
    """Fits at each limit of saturation, against the curve of their seed, as medians over the seeds."""
    return deep_limits(spark, sf_dir)[0].medians


@query("pilot_medians")
def pilot_medians(spark, sf_dir):
    """Fits of few reads a barcode, against the curve of limits of their seed, as medians over the seeds."""
    return deep_limits(spark, sf_dir, deep_library(spark, sf_dir).tags.agg(F.countDistinct("barcode")).first()[0])[1].medians


@query("target_saturation")
def target_saturation(spark, sf_dir):
    countable = fx.raw_tags(spark, sf_dir).count()
    frac = curves.target_fraction(lambda f: judged(spark, sf_dir, [f]), countable, 20.0, 25.0)
    return spark.createDataFrame([(20.0, frac)], "target double, fraction double")


HALF = KNN.replace("len(a.embedding) + 1", "len(a.embedding) // 2 + 1").replace("d AS (", "d_half AS (").replace(", k AS (", ", k_half AS (").replace("FROM d QUALIFY", "FROM d_half QUALIFY")


@query("knn_jaccard", f"WITH {KNN}, {HALF}, s AS (SELECT id, count(*) AS shared FROM k JOIN k_half USING (id, other) GROUP BY id), n AS (SELECT id, count(*) AS n FROM k GROUP BY id) SELECT id, round(coalesce(shared, 0)::DOUBLE / (2 * n - coalesce(shared, 0)), 6) AS jaccard FROM n LEFT JOIN s USING (id)")
def knn_jaccard(spark, sf_dir):
    half = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.expr("slice(embedding, 1, size(embedding) div 2)").alias("vec"))
    return stability.neighbour_jaccard(neighbours(spark, sf_dir), stability.nearest(half, 10)).select("id", F.round("jaccard", 6).alias("jaccard"))


@query("pca")
def pca(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings")
    return stability.principal_components(rows.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vec")), 10)


@query("hvg")
def hvg(spark, sf_dir):
    counts = summaries.total_matrix(judged(spark, sf_dir, [1.0])).where("value > 0")
    return stability.variable_genes(counts, counts.select("barcode").distinct().count(), 20)


@query("stream_windows", """WITH w AS (SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL)
  SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, n, round(total, 6) AS total FROM w WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""")
def stream_windows(spark, sf_dir):
    schema = fx.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")  # a stream's path is a folder or a pattern
    return windows.run_once(windows.windowed_counts(stream, ["event_type"], "value")).withColumn("total", F.round("total", 6))


@query("stream_tags", f"{RAW} {fx.tags_sql('random_hex')}")
def stream_tags(spark, sf_dir):
    """The molecule table of a stream of reads: partial tables of every batch, merged."""
    schema = fx.table(spark, sf_dir, "lineitem").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/lineite[m].parquet")  # a stream's path is a folder or a pattern
    folder = scratch(spark, "stream")
    streams.in_batches(stream, {"tags": lambda batch: fx.collapsed(fx.raw_of(batch), "random_hex")}, folder).awaitTermination()
    return streams.merged(spark, folder, "tags", ["barcode", "gene", "umi", "random_hex"], list(thinning.CLASSES))


@query("compressed_matrix", f"""{FULL}, g AS (SELECT spot AS barcode, gene, count(*) AS value FROM raw GROUP BY ALL), p AS (SELECT DISTINCT l_suppkey AS barcode FROM lineitem UNION SELECT DISTINCT o_custkey FROM orders),
  n AS (SELECT barcode, (SELECT count(*) FROM g WHERE g.barcode = p.barcode) AS n FROM p)
  SELECT row_number() OVER (ORDER BY barcode) - 1 AS row_number, barcode, coalesce(sum(n) OVER (ORDER BY barcode ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, n FROM n""")
def compressed_matrix(spark, sf_dir):
    """Where each row of a matrix starts, rows without entries too."""
    entries = droplet_counts(spark, sf_dir)
    rows = fx.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("barcode")).union(fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long")))
    return matrices.compressed(entries, rows=rows).rows.select("row_number", "barcode", "start", "n")


@query("extrapolation_bounds")
def extrapolation_bounds(spark, sf_dir):
    return curves.extrapolate_bounds(summaries.reads_histogram(judged(spark, sf_dir), 200), "seed", "frac_idx", most=3.0, points=3, replicates=50)


# --- droplets, extrapolation, communities and densities ----------------------

DROPLETS = f"{RAW}, d AS (SELECT spot AS barcode, gene, count(*) AS value FROM raw GROUP BY ALL)"


def droplet_counts(spark, sf_dir):
    return fx.raw_tags(spark, sf_dir).groupBy(F.col("spot").alias("barcode"), "gene").agg(F.count(F.lit(1)).alias("value"))


@query("droplet_calls")
def droplet_calls(spark, sf_dir):
    counts = droplet_counts(spark, sf_dir)
    middle = int(counts.groupBy("barcode").agg(F.sum("value").alias("n")).agg(F.median("n")).first()[0])
    return droplets.droplet_calls(counts, lower=middle)


#: Simple Good-Turing over barcodes of at most 600 molecules.
SHARES = f"""{DROPLETS}, t AS (SELECT barcode FROM d GROUP BY 1 HAVING sum(value) <= 600), s AS (SELECT gene, coalesce(sum(value) FILTER (barcode IN (FROM t)), 0)::BIGINT AS s FROM d GROUP BY 1),
  f AS (SELECT s AS r, count(*) AS n FROM s WHERE s > 0 GROUP BY s), z AS (SELECT r, n, lag(r) OVER w AS a, lead(r) OVER w AS b, lead(n) OVER w AS more FROM f WINDOW w AS (ORDER BY r)),
  c AS (SELECT regr_slope(ln(2.0::DOUBLE * n / (coalesce(b, 2 * r - a) - coalesce(a, 0))), ln(r)) AS slope FROM z),
  y AS (SELECT r, n, r * pow(1 + 1.0::DOUBLE / r, slope + 1) AS smooth, CASE WHEN b = r + 1 THEN (r + 1) * more::DOUBLE / n END AS raw, 1.96::DOUBLE * sqrt((r + 1)::DOUBLE * (r + 1) * more / n / n * (1 + more::DOUBLE / n)) AS spread FROM z, c),
  k AS (SELECT *, min(CASE WHEN raw IS NULL OR abs(raw - smooth) <= spread THEN r END) OVER () AS turn FROM y), e AS (SELECT r, n, CASE WHEN r < turn THEN raw ELSE smooth END AS star FROM k),
  u AS (SELECT least(greatest(coalesce(sum(n) FILTER (r = 1), 0)::DOUBLE / sum(r * n), 1 / (sum(r * n) + 1.0::DOUBLE)), sum(r * n) / (sum(r * n) + 1.0::DOUBLE)) AS unseen, sum(n * star) AS whole FROM e),
  q AS (SELECT gene, CASE WHEN s = 0 THEN unseen / count(*) FILTER (s = 0) OVER () ELSE (1 - unseen) * star / whole / CASE WHEN count(*) FILTER (s = 0) OVER () > 0 THEN 1 ELSE 1 - unseen END END AS share FROM s LEFT JOIN e ON r = s, u)"""


@query("ambient_profile", f"{SHARES} SELECT gene, round(share, 12) AS share FROM q")
def ambient_profile(spark, sf_dir):
    counts = droplet_counts(spark, sf_dir)
    totals = counts.groupBy("barcode").agg(F.sum("value").alias("total"))
    return droplets.ambient_profile(counts, totals, 600)[0].select("gene", F.round("share", 12).alias("share"))


@query("droplet_likelihood", f"{SHARES}, w AS (SELECT barcode, sum(value) AS total FROM d GROUP BY 1 HAVING sum(value) > 600) SELECT barcode, total::BIGINT AS total, round(lgamma(any_value(total) + 1) + lgamma(50) - lgamma(any_value(total) + 50) + sum(lgamma(value + 50 * share) - lgamma(50 * share) - lgamma(value + 1)), 4) AS observed FROM d JOIN w USING (barcode) JOIN q USING (gene) GROUP BY barcode, total")
def droplet_likelihood(spark, sf_dir):
    """The Dirichlet-multinomial log probability of larger barcodes, at an alpha of 50."""
    counts = droplet_counts(spark, sf_dir)
    totals = counts.groupBy("barcode").agg(F.sum("value").alias("total"))
    profile, _ = droplets.ambient_profile(counts, totals, 600)
    return droplets.likelihoods(counts, profile, totals.where("total > 600"), 50.0).select("barcode", "total", F.round("observed", 4).alias("observed"))


@query("cell_report", f"{FULL}, c AS (SELECT barcode, count(*) AS n FROM judged WHERE valid GROUP BY 1) SELECT min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM c")
def cell_report(spark, sf_dir):
    found = summaries.barcode_stats(judged(spark, sf_dir, [1.0]))
    return found.agg(F.min("molecules").alias("least"), F.max("molecules").alias("most"), F.round(F.avg("molecules"), 6).alias("mean"))


@query("discards_by_sample", f"{JUDGED} SELECT seed, frac_idx, 's' || (barcode % 3) AS sample, coalesce(sum(total) FILTER (valid), 0)::BIGINT AS reads, count(*) FILTER (valid) AS molecules, coalesce(sum(total) FILTER (NOT valid), 0)::BIGINT AS reads_discarded, count(*) FILTER (NOT valid) AS molecules_discarded FROM judged GROUP BY ALL")
def discards_by_sample(spark, sf_dir):
    named = judged(spark, sf_dir).withColumn("sample", F.concat(F.lit("s"), (F.col("barcode") % 3).cast("string")))
    return summaries.bulk_by(named, "sample").drop("saturation")


@query("filtered_bins", f"{SPOT_FULL}, pos AS ({fx.SPOTS_SQL}) SELECT (array_row // 2) * 5 + array_col // 2 AS bin_idx, gene, count(*) AS value FROM judged JOIN pos USING (barcode) WHERE valid AND ((array_row // 2) * 5 + array_col // 2) % 3 = 1 GROUP BY ALL")
def filtered_bins(spark, sf_dir):
    placed = fx.spots(spark, sf_dir).select("barcode", (F.floor(F.col("array_row") / 2) * 5 + F.floor(F.col("array_col") / 2)).cast("long").alias("bin_idx"))
    return summaries.filtered_bins(spot_molecules(spark, sf_dir), placed, placed.where("bin_idx % 3 = 1").select("bin_idx").distinct())


@query("extrapolation")
def extrapolation(spark, sf_dir):
    return curves.extrapolate(summaries.reads_histogram(judged(spark, sf_dir), 200), "seed", "frac_idx")


@query("least_size", f"{JUDGED}, h AS (SELECT seed, frac_idx, count(*) AS n, count(*) FILTER (total = 1) AS n1, count(*) FILTER (total = 2) AS n2 FROM judged WHERE valid GROUP BY ALL) SELECT seed, frac_idx, round(n + n1 * (n1 - 1) / (2 * (n2 + 1)), 6)::DOUBLE AS least_size FROM h")
def least_size(spark, sf_dir):
    found = curves.least_size(summaries.reads_histogram(judged(spark, sf_dir), 200), "seed", "frac_idx")
    return found.select("seed", "frac_idx", F.round("least_size", 6).alias("least_size"))


@query("pilot_errors")
def pilot_errors(spark, sf_dir):
    countable = fx.raw_tags(spark, sf_dir).count()
    return curves.pilot_errors(lambda fracs: judged(spark, sf_dir, fracs), countable, 10, (1, 4))


@query("scaled", f"{FULL}, g AS (SELECT barcode, gene, count(*) AS value FROM judged WHERE valid GROUP BY ALL), c AS (SELECT count(DISTINCT barcode) AS n FROM g), m AS (SELECT gene, sum(value) / n AS mean, sqrt(greatest((sum(value * value) - sum(value) * sum(value) / n) / (n - 1), 0)) AS sd FROM g, c GROUP BY gene, n) SELECT barcode, gene, round(CASE WHEN sd > 1e-12 THEN least((value - mean) / sd, 10) ELSE 0 END, 6)::DOUBLE AS z, round(CASE WHEN sd > 1e-12 THEN -mean / sd ELSE 0 END, 6)::DOUBLE AS zero FROM g JOIN m USING (gene)")
def scaled(spark, sf_dir):
    counts = summaries.total_matrix(judged(spark, sf_dir, [1.0])).where("value > 0").select("barcode", "gene", F.col("value").cast("double").alias("x"))
    found = stability.scaled(counts, counts.select("barcode").distinct().count())
    return found.select("barcode", "gene", F.round("z", 6).alias("z"), F.round("zero", 6).alias("zero"))


@query("communities")
def graph_communities(spark, sf_dir):
    return communities.communities(stability.shared_neighbours(neighbours(spark, sf_dir)))


@query("modularity", f"WITH {KNN}, e AS (SELECT least(id, other) AS a, greatest(id, other) AS b, count(*) AS w FROM k GROUP BY ALL), l AS (SELECT a, b, w FROM e UNION ALL SELECT b, a, w FROM e), p AS (SELECT x.label AS own, sum(w) AS k, coalesce(sum(w) FILTER (x.label = y.label), 0) AS i FROM l JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b GROUP BY 1) SELECT round((sum(i) / sum(k) - sum(k * k) / (sum(k) * sum(k)))::DOUBLE, 9) AS modularity FROM p")
def modularity(spark, sf_dir):
    members = fx.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return communities.modularity(stability.shared_neighbours(neighbours(spark, sf_dir)), members).select(F.round("modularity", 9).alias("modularity"))


@query("histogram2d", "SELECT least(greatest(floor((l_quantity::DOUBLE - 0) / 50 * 20), 0), 19)::BIGINT AS x_bin, least(greatest(floor((l_extendedprice::DOUBLE - 0) / 100000 * 20), 0), 19)::BIGINT AS y_bin, count(*) AS n FROM lineitem GROUP BY ALL")
def histogram2d(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    return densities.histogram2d(rows, "x", "y", (0.0, 50.0, 0.0, 100000.0), 20)


@query("density", """WITH h AS (SELECT least(greatest(floor((c_acctbal::DOUBLE + 1000) / 11000 * 100), 0), 99)::BIGINT AS f, count(*) AS n FROM customer WHERE c_acctbal IS NOT NULL GROUP BY ALL),
  z AS (SELECT sum(exp(-(i / 2.0::DOUBLE) * (i / 2.0::DOUBLE) / 2)) AS z FROM range(-8, 9) t(i))
  SELECT b AS bin, -1000 + (b + 0.5::DOUBLE) * 110 AS at, round(sum(n * exp(-((b - f) / 2.0::DOUBLE) * ((b - f) / 2.0::DOUBLE) / 2)) / ((SELECT sum(n) FROM h) * any_value(z) * 110), 9)::DOUBLE AS density
  FROM h, range(100) r(b), z WHERE abs(b - f) <= 8 GROUP BY b""")
def density(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "customer").select(F.col("c_acctbal").cast("double").alias("x"))
    return densities.density(rows, "x", -1000.0, 10000.0).select("bin", "at", F.round("density", 9).alias("density"))
