"""How well replicates agree: gene overlap, Jaccard, adjusted Rand index and neighbours."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import kept
from .interpolation import interpolated
from .neighbours import BLOCK, against_blocks

#: Points, at most, to which the trend of variances is fitted.
BUCKETS = 20_000


def gene_overlap(baseline: DataFrame, replicates: DataFrame) -> DataFrame:
    """For each barcode, fraction and seed: genes in the baseline with at least 1, 2 and 3 molecules, and the share of them found again."""
    sizes = baseline.groupBy("barcode").agg(F.count(F.lit(1)).alias("b"), F.count_if(F.col("value") == 1).alias("b1"), F.count_if(F.col("value") == 2).alias("b2"), F.count_if(F.col("value") >= 3).alias("b3p"))
    both = replicates.where("value > 0").select("seed", "frac_idx", "barcode", "gene").join(baseline.select("barcode", "gene"), ["barcode", "gene"])
    shared = both.groupBy("seed", "frac_idx", "barcode").agg(F.count(F.lit(1)).alias("shared"))
    return shared.join(sizes, "barcode").withColumn("stability", F.round(F.when(F.col("b") > 0, F.col("shared") / F.col("b")).otherwise(0.0), 6))


#: Classes of genes by their molecules in the baseline: any, 1, 2, and 3 or more.
GENE_CLASSES = {"": "true", "_1": "molecules = 1", "_2": "molecules = 2", "_3p": "molecules >= 3"}


def gene_class_stability(baseline: DataFrame, replicates: DataFrame, seeds: int, steps: int) -> DataFrame:
    """For each of `steps` fractions and each barcode of the baseline: its genes (counts, and of each class counts_1, counts_2, counts_3p), and the share of them that a replicate finds again, as a mean over `seeds` replicates (stability, stability_1 ...).

    Barcodes that a replicate doesn't have count as 0 in its mean, as do classes
    without genes. Rows with the value 0 are no genes. `baseline` is (barcode,
    gene, value), `replicates` has seed and frac_idx too.
    """
    own = baseline.where("value > 0").select("barcode", "gene", F.col("value").alias("molecules"))
    counted = lambda what: [F.count_if(F.expr(test)).alias(f"{what}{c}") for c, test in GENE_CLASSES.items()]
    sizes = own.groupBy("barcode").agg(*counted("counts"))
    found = replicates.where("value > 0").select("frac_idx", "barcode", "gene").join(own, ["barcode", "gene"]).groupBy("barcode", "frac_idx").agg(*counted("shared"))
    grid = sizes.withColumn("frac_idx", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    both = grid.join(found, ["barcode", "frac_idx"], "left").fillna(0)
    shares = [F.when(F.col(f"counts{c}") > 0, F.col(f"shared{c}") / (F.col(f"counts{c}") * seeds)).otherwise(0.0).alias(f"stability{c}") for c in GENE_CLASSES]
    return both.select("frac_idx", "barcode", *[f"counts{c}" for c in GENE_CLASSES], *shares)


def gene_class_summary(barcodes: DataFrame, least: int = 10) -> DataFrame:
    """For each fraction, over gene_class_stability: of each class the barcodes with at least `least` genes of it (counts, and fracs in percent) and the median of their stability (median_stability); over all barcodes the median number of genes (genes) and the median share of the class in percent (fgenes).

    Medians are null where no barcode has so many genes.
    """
    found = []
    for c in GENE_CLASSES:
        enough = F.col(f"counts{c}") >= least
        found += [F.count_if(enough).alias(f"counts{c}"), (100 * F.avg(enough.cast("double"))).alias(f"fracs{c}"), F.median(F.when(enough, F.col(f"stability{c}"))).alias(f"median_stability{c}"), F.median(f"counts{c}").alias(f"genes{c}")]
        if c:
            found.append((100 * F.median(F.col(f"counts{c}") / F.col("counts"))).alias(f"fgenes{c}"))
    return barcodes.groupBy("frac_idx").agg(*found)


def adjusted_rand(labels: DataFrame, a: str, b: str) -> DataFrame:
    """The adjusted Rand index of two labellings, from the sums of pairs in their contingency table."""
    pairs = lambda n: F.sum(F.col(n) * (F.col(n) - 1) / 2)
    table = labels.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    one = lambda key: table.groupBy(key).agg(F.sum("n").alias("n")).agg(pairs("n"))
    sums = table.agg(pairs("n").alias("both"), F.sum("n").alias("n")).crossJoin(one(a).toDF("in_a")).crossJoin(one(b).toDF("in_b"))  # one row each
    expected = F.col("in_a") * F.col("in_b") / (F.col("n") * (F.col("n") - 1) / 2)
    top = (F.col("in_a") + F.col("in_b")) / 2
    return sums.select(F.when(top == expected, 1.0).otherwise((F.col("both") - expected) / (top - expected)).alias("ari"))


def adjusted_rand_by(labels: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys and ari: adjusted_rand of the rows of each value of the keys, all at once."""
    pairs = lambda n: F.sum(F.col(n) * (F.col(n) - 1) / 2)
    table = kept(labels.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("n")))
    one = lambda key, name: table.groupBy(*keys, key).agg(F.sum("n").alias("n")).groupBy(*keys).agg(pairs("n").alias(name))
    sums = table.groupBy(*keys).agg(pairs("n").alias("both"), F.sum("n").alias("n")).join(one(a, "in_a"), keys).join(one(b, "in_b"), keys)
    expected = F.col("in_a") * F.col("in_b") / (F.col("n") * (F.col("n") - 1) / 2)
    top = (F.col("in_a") + F.col("in_b")) / 2
    return sums.select(*keys, F.when((F.col("n") < 2) | (top == expected), 1.0).otherwise((F.col("both") - expected) / (top - expected)).alias("ari"))


def jaccard(sets: DataFrame, key: str, item: str) -> DataFrame:
    """Of each pair of keys, smaller first: the Jaccard index of their items; two empty sets don't occur."""
    sets = sets.select(key, item).distinct()
    sizes = sets.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    keys = sizes.select(F.col(key).alias("a"), F.col("n").alias("n_a")).join(sizes.select(F.col(key).alias("b"), F.col("n").alias("n_b")), F.col("a") < F.col("b"))
    shared = sets.withColumnRenamed(key, "a").join(sets.withColumnRenamed(key, "b"), item).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    joined = keys.join(shared, ["a", "b"], "left").fillna(0, ["shared"])
    return joined.select("a", "b", F.round(F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")), 6).alias("jaccard"))


def log_normalised(counts: DataFrame, target: float = 1e4) -> DataFrame:
    """Adds log1p of the count scaled so that each barcode's sum to `target`."""
    whole = Window.partitionBy("barcode")
    return counts.withColumn("x", F.log1p(F.col("value") * target / F.sum("value").over(whole)))


def nearest(vectors: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """The k nearest other vectors of each (squared distance, then id), exactly.

    Rows are dealt into blocks of `block` at most, about; a task has the points
    of one block, and rows that ask stream past them in Arrow batches. So each
    row is shuffled once a block, and a task holds one block. Where blocks are
    few, the rows that ask are dealt to parts, for there to be enough tasks.
    """
    given = vectors.where(F.col("id").isNotNull() & F.col("vec").isNotNull())
    rows = kept(given.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")))
    blocks = max(1, -(-rows.count() // block))
    return against_blocks(rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), blocks, k)


def scaled(values: DataFrame, cells: int, most: float = 10.0) -> DataFrame:
    """Adds z, the standard score of x within its gene clipped at `most`, and zero, that of the gene's absent entries, which are counted in as 0.

    Genes without variance have z and zero 0.
    """
    sums = values.groupBy("gene").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    mean = F.col("s") / cells
    spread = F.sqrt(F.greatest((F.col("q") - F.col("s") * mean) / (cells - 1), F.lit(0.0)))
    sums = sums.select("gene", mean.alias("mean"), spread.alias("sd"))
    score = lambda x: F.when(F.col("sd") > 1e-12, F.least((x - F.col("mean")) / F.col("sd"), F.lit(most))).otherwise(0.0)
    return values.join(sums, "gene").withColumns({"z": score(F.col("x")), "zero": score(F.lit(0.0))}).drop("mean", "sd")


def shared_neighbours(neighbours: DataFrame) -> DataFrame:
    """(a, b, weight) of a graph from lists of neighbours (id, other): 1 for each direction in which a pair is near."""
    return neighbours.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def neighbour_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of each id the Jaccard index of its neighbours in two lists (id, other)."""
    size = lambda df, name: df.groupBy("id").agg(F.count(F.lit(1)).alias(name))
    shared = size(a.select("id", "other").join(b.select("id", "other"), ["id", "other"]), "shared")
    sizes = size(a, "n_a").join(size(b, "n_b"), "id", "full").join(shared, "id", "left").fillna(0, ["n_a", "n_b", "shared"])
    return sizes.select("id", (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("jaccard"))


def principal_components(vectors: DataFrame, k: int) -> DataFrame:
    """id and the k first principal components of vec; the covariance is summed over partitions."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select("id", array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    return PCA(k=k, inputCol="features", outputCol="pcs").fit(rows).transform(rows).select("id", vector_to_array("pcs").alias("pcs"))


def dense_vectors(scores: DataFrame, genes: list) -> DataFrame:
    """id and vec of each barcode of `scores` (barcode, gene, z, zero): z of the given genes in their order, and zero where the barcode has none.

    A barcode's own scores are one list, as long as `genes` at most; the vectors are filled in Arrow batches.
    """
    places = scores.sparkSession.createDataFrame([(g, i) for i, g in enumerate(genes)], T.StructType([scores.schema["gene"], T.StructField("place", T.IntegerType())]))
    placed = scores.join(F.broadcast(places), "gene")  # a list of genes
    zero = np.zeros(len(genes))
    for r in placed.groupBy("place").agg(F.first("zero").alias("zero")).collect():
        zero[r["place"]] = r["zero"]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                out = np.tile(zero, (part.num_rows, 1))
                own = part.column(1)
                flat = own.flatten()
                row = np.asarray(pc.list_parent_indices(own))
                out[row, flat.field(0).to_numpy()] = flat.field(1).to_numpy()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * len(zero), pa.int32()), pa.array(out.ravel()))], ["id", "vec"])

    own = placed.groupBy(F.col("barcode").cast("long").alias("id")).agg(F.collect_list(F.struct("place", "z")).alias("own"))
    return own.mapInArrow(fill, "id long, vec array<double>")


#: Share of the genes that a local regression at one place looks at, and places at which it is fitted.
SPAN, KNOTS = 0.3, 200


def local_trend(x: np.ndarray, y: np.ndarray, weight: np.ndarray, at: np.ndarray, span: float = SPAN) -> np.ndarray:
    """Local quadratic regression of y on x with tricube weights, at the places `at`; `weight` is how many rows a point stands for."""
    order = np.argsort(x, kind="stable")
    x, y, weight = x[order], y[order], weight[order]
    need = max(3.0, np.floor(span * weight.sum() + 1e-9))
    out = np.empty(len(at))
    for i, a in enumerate(at):
        d = np.abs(x - a)
        near = np.argsort(d, kind="stable")
        width = d[near[min(np.searchsorted(np.cumsum(weight[near]), need), len(x) - 1)]]
        w = weight * np.where(d <= width, (1 - (d / width) ** 3) ** 3 if width > 0 else 1.0, 0.0)
        basis = np.stack([np.ones_like(x), x - a, (x - a) ** 2], 1) * np.sqrt(w)[:, None]
        out[i] = np.linalg.lstsq(basis, y * np.sqrt(w), rcond=None)[0][0]
    return out


def variable_genes(counts: DataFrame, cells: int, top: int, span: float = SPAN) -> DataFrame:
    """gene and score of the `top` genes of largest standardised variance: against the local trend of log variance over log mean, clipped at sqrt(cells) deviations.

    `counts` (barcode, gene, value) need not hold zeros; they are counted in.
    The trend is fitted to at most `BUCKETS` points, means of genes of about the
    same log mean (all genes by themselves if there are fewer); only those come
    to the driver. A gene's expected variance lies between the trend's knots.
    """
    moments = counts.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.count(F.lit(1)).alias("seen"))
    moments = moments.withColumn("mean", F.col("s") / cells).withColumn("var", (F.col("q") - F.col("s") * F.col("s") / cells) / (cells - 1))
    logs = kept(moments.where("var > 0").withColumns({"x": F.log10("mean"), "y": F.log10("var")}))
    ends = logs.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).first()
    if not ends["n"]:
        return moments.limit(0).select("gene", F.lit(0.0).alias("score"))
    step = (ends["high"] - ends["low"]) / BUCKETS
    place = F.col("gene") if ends["n"] <= BUCKETS or not step else F.floor((F.col("x") - ends["low"]) / step)
    points = logs.groupBy(place.alias("place")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).toArrow()
    x, y, n = (points[c].to_numpy().astype(float) for c in ("x", "y", "n"))
    knots = np.unique(np.quantile(x, np.linspace(0, 1, KNOTS))) if len(x) > KNOTS else np.unique(x)
    fitted = local_trend(x, y, n, knots, span)
    table = counts.sparkSession.createDataFrame(list(zip(knots.tolist(), fitted.tolist(), strict=True)), "x double, y double")
    trend = logs.join(interpolated(table, logs, lambda c: c).withColumnRenamed("y", "expected"), "x").withColumn("sd", F.sqrt(F.pow(F.lit(10.0), "expected")))
    z = F.least((F.col("value") - F.col("mean")) / F.col("sd"), F.lit(float(cells) ** 0.5))
    found = counts.join(trend, "gene").groupBy("gene").agg(F.sum(z * z).alias("square"), F.first("seen").alias("seen"), F.first(F.pow(F.col("mean") / F.col("sd"), F.lit(2))).alias("zero"))
    score = (F.col("square") + (cells - F.col("seen")) * F.col("zero")) / (cells - 1)
    return found.select("gene", score.alias("score")).orderBy(F.desc("score"), "gene").limit(top)
