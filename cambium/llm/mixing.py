"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, served at a rate
in proportion to its target; a source whose target exceeds its size is queued
again, as one more epoch in another order. A piece of a document has the
virtual finish time (words of its source up to its end) / (target of its
source). Pieces are sorted by it over all sources, and the mix ends where the
running number of words reaches the budget. Where a source's target falls
inside a document, the document is queued as two pieces, one up to the target
and one after it, so that every source comes to its target within a word or so
rather than within its longest document.

Running sums over all rows come from one range shuffle and one sum a
partition (`common.running`), so a source with a third of all rows is spread
over tasks like any other; texts are read once, to be counted, and never
shuffled. Targets are found by a few aggregates over one row a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_ROWS, cut, read, running

WEIGHTS = (1, 2, 3)
#: A source is taken this many times at most.
MOST = 3
SEED = 0


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """row_id, doc_id, source, size (words) and key (the document's place in the shuffle, by seed, id and text) of each row, written once."""
    text = F.col(text_col)
    return cut(
        docs.select(
            F.monotonically_increasing_id().alias("row_id"),
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
            F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"), F.md5(text))).alias("key"),
        )
    )


def level(sources: DataFrame, budget: int) -> float:
    """The words a unit of weight gets when `budget` is shared by `weight` and no source gets more than its `cap`."""
    full, found = -1, 0.0
    while True:
        above = F.col("cap") < F.col("weight") * F.lit(found)
        row = sources.agg(F.count_if(above).alias("full"), F.sum(F.when(above, F.col("cap"))).alias("fixed"), F.sum(F.when(~above, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            return float("inf") if row["full"] else 0.0
        if row["full"] == full:
            return found
        full, found = row["full"], (budget - (row["fixed"] or 0)) / row["open"]


def targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, budget: int | None = None) -> tuple[DataFrame, int]:
    """One row a source: source, source_size, rank, weight, target, epochs and before (words queued by the sources before it); and the budget.

    Sources in the order of code points, null last, take `weights` in turn.
    They share the budget (None: the words of all documents) by weight, each up
    to `most` times its size; what is above is shared again by weight.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("__one", F.lit(1).cast("long"))
    ranked = running(sizes, [F.col("source").asc_nulls_last()], "__one", "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    sources = cut(ranked.select("source", "source_size", "rank", weight.alias("weight"), (F.col("source_size") * most).alias("cap")))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget = total if budget is None else budget
    share = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level(sources, budget)))
    epochs = F.when(F.col("source_size") == 0, F.lit(1)).otherwise(F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.col("target") / F.col("source_size")))))
    found = sources.withColumn("target", F.when(F.col("cap") == 0, F.lit(0.0)).otherwise(share)).withColumn("epochs", epochs.cast("int"))
    queued = found.withColumn("__queued", F.col("epochs") * F.col("source_size"))
    return running(queued, [F.col("rank")], "__queued", "before").drop("__queued", "cap"), budget


def queue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """The mix and what is left over: one row a piece, in `place` order.

    row_id, doc_id, size, source, source_size, target, epoch (from 0),
    from_word (place in the document), words, finish (virtual time), place
    (words of the mix before it) and taken (words of the piece that are in the
    mix: all, none, or those up to the budget). A null text has no words; rows
    without words are there with none. Null ids and repeated rows are rows of
    their own. An empty table gives no rows; other columns are never read.
    """
    rows = sized(docs, id_col, text_col, source_col, seed)
    sources, budget = targets(rows, weights, most, budget)
    sources = cut(sources)
    if sources.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        sources = F.broadcast(sources)
    named = rows.join(sources.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    copies = named.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1))).withColumn("key", F.md5(F.concat_ws("|", F.col("epoch").cast("string"), "key")))
    # Sources follow each other, so a source's own sum is what remains above the sources before it.
    queued = running(copies, [F.col("rank"), F.col("epoch"), F.col("key")], "size", "__all").withColumn("start", F.col("__all") - F.col("before"))
    end, goal = F.col("start") + F.col("size"), F.floor("target")
    inside = (F.col("start") < goal) & (goal < end)
    piece = lambda at, to: F.struct(at.alias("at"), to.alias("to"))
    pieces = queued.withColumn("piece", F.explode(F.when(inside, F.array(piece(F.col("start"), goal), piece(goal, end))).otherwise(F.array(piece(F.col("start"), end)))))
    timed = pieces.select(
        "row_id", "doc_id", "size", "source", "source_size", "target", "rank", "epoch", "key",
        (F.col("piece.at") - F.col("start")).alias("from_word"),
        (F.col("piece.to") - F.col("piece.at")).alias("words"),
        F.when(F.col("target") > 0, F.col("piece.to") / F.col("target")).otherwise(F.lit(0.0)).alias("finish"),
    )
    placed = running(timed, [F.col(c) for c in ("finish", "rank", "epoch", "key", "from_word")], "words", "place")
    return placed.withColumn("taken", F.greatest(F.lit(0), F.least("words", F.lit(budget) - F.col("place")))).drop("rank", "key")


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken (words that the mix takes, repeats counted) and first_at (place of its first word in the mix, null if none is taken). Options as in `queue`."""
    pieces = queue(docs, **options)
    # Copies of a row differ in nothing that is grouped by.
    return pieces.groupBy("row_id", "doc_id", "size", "source_size", "target").agg(F.sum("taken").alias("taken"), F.min(F.when(F.col("taken") > 0, F.col("place"))).alias("first_at")).drop("row_id")


def op13_source_mixing(spark, sf_dir):
    return mix(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat_ws('|', '0', CAST(doc_id AS VARCHAR), md5(text))) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source
), w AS (SELECT *, 1 + rank % 3 AS weight, 3 * source_size AS cap FROM s
), l AS (
  SELECT (sum(source_size) OVER () - (sum(cap) OVER o - cap))::DOUBLE / (sum(weight) OVER () - (sum(weight) OVER o - weight))::DOUBLE AS level
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, rank ROWS UNBOUNDED PRECEDING)
), t AS (
  SELECT *, least(cap::DOUBLE, weight * (SELECT max(level) FROM l)) AS target FROM w
), e AS (
  SELECT *, CASE WHEN source_size = 0 THEN 1 ELSE least(3, greatest(1, CAST(ceil(target / source_size) AS BIGINT))) END AS epochs FROM t
), c AS (
  SELECT d.*, source_size, target, rank, epoch, md5(concat_ws('|', CAST(epoch AS VARCHAR), key)) AS copy
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source, LATERAL (SELECT unnest(range(epochs)) AS epoch)
), q AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY rank ORDER BY epoch, copy ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start, CAST(floor(target) AS BIGINT) AS goal FROM c
), p AS (
  SELECT *, start AS a, CASE WHEN start < goal AND goal < start + size THEN goal ELSE start + size END AS b FROM q
  UNION ALL SELECT *, goal AS a, start + size AS b FROM q WHERE start < goal AND goal < start + size
), f AS (
  SELECT *, CAST(sum(b - a) OVER (ORDER BY CASE WHEN target > 0 THEN b / target ELSE 0 END, rank, epoch, copy, a ROWS UNBOUNDED PRECEDING) AS BIGINT) - (b - a) AS place FROM p
), k AS (SELECT *, greatest(0, least(b - a, (SELECT CAST(sum(size) AS BIGINT) FROM d) - place)) AS got FROM f)
SELECT doc_id, size, source_size, target, CAST(sum(got) AS BIGINT) AS taken, min(place) FILTER (got > 0) AS first_at
FROM k GROUP BY row_id, doc_id, size, source_size, target
"""
