"""Secret scanning, with the corpus-wide frequency of owners to tell examples from live credentials.

Each text is scanned once. The hashes of what is found, never the values, are
counted over distinct repositories and owners: a value that several owners or
many repositories have is a widely copied example, one that a single owner has
in few of them may be live.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, read, sliced, utf8

#: Kind, pattern and the least number of characters of its last group (0: of all). The first three are the base kinds.
KINDS = [
    ("assign", re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile(rb"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(rb"[0-9a-f]{16,}"), 0, 16),
    ("forge", re.compile(rb"gh[opsur]_[A-Za-z0-9]{36,}"), 0, 40),
    ("chat", re.compile(rb"xox[abprs]-[A-Za-z0-9-]{10,}"), 0, 15),
    ("payment", re.compile(rb"[prs]k_(?:live|test)_[A-Za-z0-9]{16,}"), 0, 24),
    ("jwt", re.compile(rb"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 29),
    ("pem", re.compile(rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:(?:[ \t\r\n]+[A-Za-z-]+:[^\n]*)*[A-Za-z0-9+/= \t\r\n]*-----END (?:[A-Z]+ )*PRIVATE KEY-----)?"), 0, 0),
]
BASE = 3
#: A value that at least so many owners, or so many repositories, have is an example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 10
#: A live credential has at least so many bits of entropy in a character.
LIVE_BITS = 2.5

FOUND = "n_assign long, n_access long, n_hex long, base string, spans string, candidates array<struct<hash:string,span:string,bits:double>>"


def entropy(value: bytes) -> float:
    n = len(value)
    return round(-sum(k / n * math.log2(k / n) for k in Counter(value).values()), 9) if n else 0.0


def scan(text: bytes) -> list[tuple[int, int, int, bytes]]:
    """Start and end in characters, number of the kind and value of each find, by start and then kind."""
    found = []
    for kind, (_, pattern, group, least) in enumerate(KINDS):
        for m in pattern.finditer(text):
            if len(m[group]) >= least:
                found.append((m.start(), kind, m.end(), m[group]))
    found.sort(key=lambda f: f[:2])
    out, at, chars = [], 0, 0
    for start, kind, end, value in found:
        chars += len(text[at:start].decode(errors="replace")) if start else 0
        at = start
        out.append((chars, chars + len(text[start:end].decode(errors="replace")), kind, value))
    return out


def scanned(docs: DataFrame) -> DataFrame:
    """`docs`, whose last column is the text, with FOUND in its place."""
    last = len(docs.columns) - 1
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.list_(pa.struct([("hash", pa.string()), ("span", pa.string()), ("bits", pa.float64())]))]
    names = [*docs.columns[:-1], "n_assign", "n_access", "n_hex", "base", "spans", "candidates"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, last):
            rows = []
            for text in utf8(batch.column(last)):
                found = scan(text) if text else []
                spans = [f"{KINDS[k][0]}:{a}:{b}" for a, b, k, _ in found]
                counts = Counter(k for _, _, k, _ in found)
                base = ",".join(s for s, f in zip(spans, found, strict=True) if f[2] < BASE)
                values = [{"hash": hashlib.sha256(f[3]).hexdigest(), "span": s, "bits": entropy(f[3])} for s, f in zip(spans, found, strict=True)]
                rows.append((counts[0], counts[1], counts[2], base, ",".join(spans), values))
            added = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], *added], names)

    return docs.mapInArrow(find, f"{schema}, {FOUND}")


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id",
    example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES, live_bits: float = LIVE_BITS,
) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base and spans (kind:start:end, comma-joined), n_examples, n_live, most_repositories, live_spans.

    A value that at least `example_owners` distinct owners or
    `example_repositories` distinct repositories have is an example; one of a
    single owner that isn't, with at least `live_bits` bits of entropy in a
    character, looks live. Null texts are empty; null owners and repositories
    count as none. Repeated rows and ids keep one row each.
    """
    rows = cut(
        scanned(
            docs.select(
                F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), F.col(owner_col).alias("owner"),
                F.col(repository_col).alias("repository"), F.col(text_col).alias("text"),
            )
        )
    )
    each = rows.where(F.size("candidates") > 0).select("row_id", "owner", "repository", F.posexplode("candidates").alias("nr", "c")).select("row_id", "owner", "repository", "nr", "c.*")
    # Distinct owners and repositories first, so a value that very many rows have is counted in parts.
    owners = each.where("owner is not null").groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("one").alias("owners"))
    places = each.where("repository is not null").groupBy("hash", "repository").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("one").alias("repositories"))
    # The key is made anew on both sides, so the counts are dealt once more and Spark may split the rows of a value that very many have.
    counts = owners.join(places, "hash", "full").select(F.struct("hash").alias("key"), "owners", "repositories")
    judged = (
        each.withColumn("key", F.struct("hash"))
        .join(counts, "key", "left")
        .withColumn("example", (F.coalesce("owners", F.lit(0)) >= example_owners) | (F.coalesce("repositories", F.lit(0)) >= example_repositories))
        .withColumn("live", ~F.col("example") & (F.coalesce("owners", F.lit(0)) == 1) & (F.col("bits") >= live_bits))
        .groupBy("row_id")
        .agg(
            F.count_if("example").alias("n_examples"),
            F.count_if("live").alias("n_live"),
            F.max("repositories").alias("most_repositories"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("live"), F.struct("nr", "span")))), lambda s: s["span"]), ",").alias("live_spans"),
        )
    )
    return rows.join(judged, "row_id", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base", "spans",
        F.coalesce("n_examples", F.lit(0)).alias("n_examples"), F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("most_repositories", F.lit(0)).alias("most_repositories"), F.coalesce("live_spans", F.lit("")).alias("live_spans"),
    )


def op9_secret_scan(spark, sf_dir):
    return find_secrets(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_examples", "n_live", "most_repositories", "live_spans"
    )


def _sql() -> str:
    kinds, places = [], []
    for nr, (name, pattern, group, least) in enumerate(KINDS):
        text = re.sub(r"\(\?i:(.*?)\)\)", lambda m: re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1]) + ")", pattern.pattern.decode()).replace("'", "''")
        # Matches between marks; what stands before a mark adds up to its place.
        kinds.append(f"""k{nr} AS (
  SELECT rid, {nr} AS nr, '{name}' AS kind, i, split_part(part, chr(2), 1) AS found, length(replace(part, chr(2), '')) AS size
  FROM (SELECT rid, unnest(parts) AS part, unnest(range(len(parts))) AS i
        FROM (SELECT rid, string_split(regexp_replace(text, '{text}', chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS parts FROM d))
)""")
        places.append(f"""
  SELECT rid, nr, kind, before AS begins, before + length(found) AS ends, regexp_extract(found, '{text}', {group}) AS value
  FROM (SELECT *, sum(size) OVER (PARTITION BY rid ORDER BY i) - size AS before FROM k{nr})
  WHERE i > 0 AND length(regexp_extract(found, '{text}', {group})) >= {least}""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), {", ".join(kinds)}, f AS ({" UNION ALL ".join(places)}
), e AS (
  SELECT value, round(-sum(n / size * log2(n / size)), 9) AS bits
  FROM (SELECT value, c, count(*)::DOUBLE AS n, length(value)::DOUBLE AS size FROM (SELECT value, unnest(string_split(value, '')) AS c FROM (SELECT DISTINCT value FROM f)) GROUP BY ALL)
  GROUP BY value
), c AS (SELECT value, count(DISTINCT source) AS owners, count(DISTINCT doc_id) AS repositories FROM f JOIN d USING (rid) GROUP BY value
), j AS (
  SELECT f.*, kind || ':' || CAST(begins AS BIGINT) || ':' || CAST(ends AS BIGINT) AS span, repositories,
         owners >= {EXAMPLE_OWNERS} OR repositories >= {EXAMPLE_REPOSITORIES} AS example, owners = 1 AND repositories < {EXAMPLE_REPOSITORIES} AND bits >= {LIVE_BITS} AS live
  FROM f JOIN c USING (value) JOIN e USING (value)
), a AS (
  SELECT rid, count(*) FILTER (nr = 0) AS n0, count(*) FILTER (nr = 1) AS n1, count(*) FILTER (nr = 2) AS n2,
         string_agg(span, ',' ORDER BY begins, nr) FILTER (nr < {BASE}) AS base, string_agg(span, ',' ORDER BY begins, nr) AS spans,
         count(*) FILTER (example) AS examples, count(*) FILTER (live) AS lives, max(repositories) AS most, string_agg(span, ',' ORDER BY begins, nr) FILTER (live) AS live_spans
  FROM j GROUP BY rid
)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(examples, 0) AS n_examples, coalesce(lives, 0) AS n_live, coalesce(most, 0) AS most_repositories, coalesce(live_spans, '') AS live_spans
FROM d LEFT JOIN a USING (rid)
"""


SQL = _sql()
