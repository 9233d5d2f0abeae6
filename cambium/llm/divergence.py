"""How far the sources of a language are apart in the words they use, by an inverted index of corrections to a baseline.

A source gives each kept term a smoothed share p of its words; two sources are
sum |p - p'| apart. Most sources have most terms not at all, and all those
terms have one share in a source. So each pair starts at V times the distance
f of two zero counts, and the index (a term's postings: the sources that have
it) emits what differs from that: for a posting and every other source of the
language, |p - p'| - f, if it isn't 0. Terms that neither source has cost
nothing. A term that two sources have is told by both postings; one that only
one of them has counts for both directions.

Words are counted inside tasks first, in tables of bounded size, so a common
word or a source with a third of all documents reaches the shuffle as one row a
task; after one shuffle by language and term, all that decides about a term is
in one place. Postings are dealt in blocks of sources, so no array grows with
the number of sources. All arithmetic is in integers (decimals of 38 digits).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL_ROWS, cut, read, sliced, utf8

MIN_DOCS = 30
TOP = 50
SMOOTH = 5
SCALE = 1_000_000_000
#: Sources of a block of postings, about.
BLOCK = 256
#: Counts held by a task before it sends them on.
HELD = 150_000

#: Of bytes, A-Z (lower-cased), a-z and those above 0x7F make terms; the rest parts them.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", held: int = HELD) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it), in parts: one row a task and term, or more where a task has many terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def packed() -> pa.RecordBatch:
            rows = [(lang, source, term, n, seen[term]) for (lang, source), (all_, seen) in found.items() for term, n in all_.items()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            arrays[2] = arrays[2].cast(pa.string())
            found.clear()
            return pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])

        size = 0
        for batch in sliced(batches, 2):
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                words = text.translate(TERM_BYTES).split()
                if not words:
                    continue
                total, seen = found.setdefault((lang, source), (Counter(), Counter()))
                size -= len(total)
                total.update(words)
                seen.update(set(words))
                size += len(total)
                if size > held:
                    yield packed()
                    size = 0
        yield packed()

    empty = F.lit("")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), empty).alias("lang"), F.coalesce(F.col(source_col).cast("string"), empty).alias("source"), F.coalesce(F.col(text_col), empty).alias("text"))
    return rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def share(count: str, total: str, terms: str):
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), exact; null if there are no terms."""
    whole = lambda name: f"cast({name} AS decimal(20,0))"
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + ({whole(count)} + {SMOOTH}) * {SCALE} div ({whole(total)} + {SMOOTH} * {whole(terms)}) END")


class Index:
    """The kept terms of each language and their postings.

    `kept` has lang, source, term and n; `groups` one row for each lang and
    source, also those without terms: total (of n), terms (V of the language)
    and zero (the share of a term that the source doesn't have).
    """

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS, block: int = BLOCK, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"):
        whole = Window.partitionBy("lang", "term")
        counted = term_counts(docs, text_col, lang_col, source_col).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        self.kept = cut(counted.withColumn("__docs", F.sum("docs").over(whole)).where(F.col("__docs") >= min_docs).select("lang", "source", "term", "n"))
        self.terms = self.kept.groupBy("lang", "term").agg(F.sum("n").alias("n"))
        self.langs = self.terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
        empty = F.lit("")
        named = docs.select(F.coalesce(F.col(lang_col).cast("string"), empty).alias("lang"), F.coalesce(F.col(source_col).cast("string"), empty).alias("source")).distinct()
        sums = self.kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        sized = named.join(sums, ["lang", "source"], "left").join(self.langs, "lang", "left").fillna(0, ["total", "terms", "lang_total"]).withColumn("none", F.lit(0))
        blocks = named.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
        dealt = sized.withColumn("zero", share("none", "total", "terms")).drop("none").join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")))
        self.groups = cut(dealt)
        self.small = self.groups.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS

    def beside(self, other: DataFrame) -> DataFrame:
        """A table made of one row a source at most, broadcast if it is small enough."""
        return F.broadcast(other) if self.small else other

    def postings(self) -> DataFrame:
        """lang, term, source, n, p and zero of every term that a source has."""
        return self.kept.join(self.beside(self.groups), ["lang", "source"]).withColumn("p", share("n", "total", "terms"))

    def corrections(self) -> DataFrame:
        """lang, source, item and value: what the terms of two sources of a language add to their baseline; pairs without any are left out."""
        posted = cut(self.postings().groupBy("lang", "term", "block", "blocks").agg(F.collect_list(F.struct("source", "p", "zero")).alias("own")))
        asked = posted.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        sources = self.groups.where("terms > 0").groupBy("lang", F.col("block").alias("other")).agg(F.collect_list(F.struct("source", "zero")).alias("all"))
        theirs = posted.select("lang", "term", F.col("block").alias("other"), F.map_from_entries(F.transform("own", lambda x: F.struct(x["source"], x["p"]))).alias("theirs"))
        met = asked.join(self.beside(sources), ["lang", "other"]).join(theirs, ["lang", "term", "other"], "left")
        emitted = met.select("lang", F.explode(F.expr("""
            filter(flatten(transform(own, a -> transform(filter(all, b -> b.source != a.source), b -> named_struct(
                'source', a.source, 'item', b.source, 'both', theirs[b.source] IS NOT NULL,
                'value', abs(a.p - coalesce(theirs[b.source], b.zero)) - abs(a.zero - b.zero))))), x -> x.value != 0)""")).alias("x"))  # fmt: skip
        summed = cut(emitted.groupBy("lang", "x.source", "x.item", "x.both").agg(F.sum("x.value").alias("value")))
        mirrored = summed.where("NOT both").select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "both", "value")
        return summed.unionByName(mirrored).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    def pairs(self) -> DataFrame:
        """lang, source, item (each other source of the language) and value, the distance of the two."""
        one = self.groups.select("lang", "source", "terms", "zero")
        other = self.groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"))
        # The contract asks for a row for every pair of sources; documents and terms aren't paired.
        base = one.join(self.beside(other), "lang").where("source != item")
        value = F.coalesce(F.col("terms") * F.abs(F.col("zero") - F.col("item_zero")), F.lit(0)) + F.coalesce("value", F.lit(0))
        return base.join(self.corrections(), ["lang", "source", "item"], "left").select("lang", "source", "item", value.alias("value"))

    def telling_terms(self, top: int = TOP) -> DataFrame:
        """lang, source, item (a term that the source uses more than its language does), value and rank, the `top` largest of each source."""
        lang = self.terms.join(F.broadcast(self.langs) if self.small else self.langs, "lang").select("lang", "term", share("n", "lang_total", "terms").alias("q"))
        more = self.postings().join(lang, ["lang", "term"]).where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        return ranked(more).where(F.col("rank") <= top)


def ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, **columns) -> DataFrame:
    """lang, source, part, item, value and rank: the distance of each source to every other of its language (`pair`) and the terms that set it apart (`term`).

    Null texts, languages and sources count as empty ones. A source without
    kept terms is there with its zero shares; in a language without kept terms
    all distances are 0. Ties go to the smaller item by UTF-8 bytes; repeated
    rows count again; an empty table gives no rows. Other columns are never read.
    """
    index = Index(docs, min_docs, **columns)
    names = ["lang", "source", "part", "item", "value", "rank"]
    pairs = ranked(index.pairs()).withColumn("part", F.lit("pair")).select(*names)
    return pairs.unionByName(index.telling_terms(top).withColumn("part", F.lit("term")).select(*names))


def op12_source_divergence(spark, sf_dir):
    return audit(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), w AS (SELECT id, lang, source, unnest(words) AS term FROM d
), k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 30
), v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang
), g AS (SELECT DISTINCT lang, source FROM d
), c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL
), grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN k ON g.lang = k.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT *, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * (SELECT v FROM v WHERE v.lang = grid.lang)) AS p FROM grid
), t AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM grid GROUP BY ALL
), q AS (SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM t
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, CAST(p.p - q.q AS BIGINT) FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 50
"""
