"""Text sources: annotation, alignment text, barcode indexes, gene lists, summaries and probe sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BARCODE_INDEX = "barcode string, barcode_idx int, total_reads long, countable_reads long, raw_molecules long, offset long, total_bytes long, sample string, countable_random_hex long, countable_poly_A long"
GENE_MAP = "gene_index int, gene_id string, gene_name string"
POSITIONS = "barcode string, in_tissue int, array_row int, array_col int"
SUMMARY = "key string, type string, value string"


def gtf_fields(attributes: str, *names: str) -> list[Column]:
    """Named attributes; a missing gene_name is the gene_id, other missing ones are null."""
    found = {n: F.nullif(F.regexp_extract(attributes, rf'{n}\s+"?([^;"]+)"?;', 1), F.lit("")) for n in {*names, "gene_id"}}
    return [(F.coalesce(found[n], found["gene_id"]) if n == "gene_name" else found[n]).alias(n) for n in names]


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Genes and exons of an annotation, plain or compressed; ends are closed and count from 0. A line without gene_id fails the job."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where("value <> '' and not startswith(value, '#')")
    kept = rows.select(
        parts[0].alias("chrom"), parts[2].alias("feature"), (parts[3].cast("long") - 1).alias("lft"), (parts[4].cast("long") - 1).alias("rgt"), parts[6].alias("strand"), parts[8].alias("attributes")
    ).where(F.col("feature").isin("gene", "exon"))
    named = kept.select("*", *gtf_fields("attributes", "gene_id", "gene_name", "transcript_id")).drop("attributes")
    return named.withColumn("gene_id", F.coalesce("gene_id", F.raise_error(F.lit("a line without gene_id")).cast("string")))


def read_sam(spark: SparkSession, path: str, tags: dict[str, str] | None = None) -> DataFrame:
    """Alignment text: qname, flag, chrom (null if unmapped), pos (from 0), mapq, cigar and one column for each wanted tag."""
    return sam_fields(spark.read.text(path), tags)


def stream_sam(spark: SparkSession, path: str, tags: dict[str, str] | None = None, files_a_batch: int = 1) -> DataFrame:
    """read_sam of the files that a folder has and will have, as a stream."""
    return sam_fields(spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(path), tags)


def sam_fields(lines: DataFrame, tags: dict[str, str] | None = None) -> DataFrame:
    tags = tags or {"cb": "CB", "umi": "UR", "gx": "GX"}
    parts = F.split("value", "\t")
    rows = lines.where("not startswith(value, '@') and value <> ''")
    return rows.select(
        parts[0].alias("qname"), parts[1].cast("int").alias("flag"), F.nullif(parts[2], F.lit("*")).alias("chrom"), (parts[3].cast("long") - 1).alias("pos"), parts[4].cast("int").alias("mapq"), parts[5].alias("cigar"),
        *[F.nullif(F.regexp_extract("value", rf"\t{tag}:Z:([^\t]*)", 1), F.lit("")).alias(name) for name, tag in tags.items()],
    )


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def read_barcode_index(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, BARCODE_INDEX)


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True)
    return rows.select("barcode", *[F.col(c).cast("int") for c in ("array_row", "array_col", "in_tissue")])


def read_gene_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("gene_id")).where("gene_id <> '' and not startswith(gene_id, '#')").distinct()


def unknown_genes(listed: DataFrame, genes: DataFrame) -> DataFrame:
    """Ids of a gene list that the annotation doesn't have."""
    return listed.join(genes.select("gene_id"), "gene_id", "left_anti")


def annotated(barcodes: DataFrame, *sources: DataFrame | None) -> DataFrame:
    """Barcodes with the columns of the first source (by barcode) that there is; without any, as they are."""
    found = next((s for s in sources if s is not None), None)
    return barcodes if found is None else barcodes.join(found, "barcode", "left")


def summary_values(summary: DataFrame) -> DataFrame:
    """Key and type with the value as a whole number, else a number, else text."""
    return summary.select("key", "type", F.expr("try_cast(value as long)").alias("whole"), F.expr("try_cast(value as double)").alias("number"), "value")


def read_extrapolation(spark: SparkSession, path: str) -> DataFrame:
    """Reads and expected molecules of an extrapolation's output; comments, headers and rows without positive reads are passed over."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("not startswith(value, '#')").where(F.size(parts) >= 2)
    numbers = rows.select(parts.alias("parts")).select(F.expr("try_cast(parts[0] as double)").alias("reads"), F.expr("try_cast(parts[1] as double)").alias("molecules"))
    return numbers.where("reads > 0 and molecules is not null").groupBy("reads").agg(F.min("molecules").alias("molecules"))


def excluded_probes(probes: DataFrame) -> DataFrame:
    """Genes of the probes that aren't included, without the mark of deprecated ones."""
    gene = F.regexp_replace(F.split_part("probe_id", F.lit("|"), F.lit(1)), "^DEPRECATED_", "")
    return probes.where(~F.col("included")).select(gene.alias("gene_id")).distinct()


def write_tsv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True, compression="gzip")


def write_tags(tags: DataFrame, path: str) -> None:
    """The molecule table, dealt and sorted by barcode so that readers can skip row groups."""
    keys = [c for c in ("barcode", "gene", "umi", "random_hex") if c in tags.columns]
    tags.repartitionByRange("barcode").sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
