"""Removal of word windows that occur more than once, by Rabin-Karp hashes.

Every window of a document gets a 64-bit rolling hash of its words. A map task
gathers documents into units of bounded size; within a unit, equal hashes meet
at once, so each unit sends a hash on once at most, however often it occurs
there. Hashes are shuffled by their leading byte (or more) in packed rows and
counted; the places of those that other units have too go back to their unit,
which merges overlapping windows into maximal intervals for each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, maybe_in, read, sliced, utf8

WINDOW = 35
#: Words of the documents of one unit, about.
UNIT_WORDS = 2_000_000
#: Hashes and places of one bucket and of one partition take about so many bytes at most: buckets and partitions follow the input.
BUCKET_BYTES, PARTITION_BYTES = 64 << 20, 256 << 20
#: Hash and place of a window take 12 bytes, and a word at least 2 bytes of text.
PACKED_BYTES = 6
#: Words whose hashes a task remembers.
CACHE = 500_000
#: Multiplier of the rolling hash: odd, so it has an inverse modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

PACKED = "bucket int, unit long, hashes binary, places binary"
FOUND = "unit long, kind int, places binary"
SPANS = "key1 long, key2 long, spans array<int>"


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def rolling(hashes: np.ndarray, window: int) -> np.ndarray:
    """The polynomial hash, modulo 2^64, of each `window` consecutive word hashes; its bits are mixed so that any of them can be used."""
    n = len(hashes)
    powers = np.cumprod(np.full(n + 1, BASE, np.uint64))
    inverse = np.cumprod(np.full(n, INVERSE, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * inverse)])
    x = (sums[window:] - sums[:-window]) * powers[: n - window + 1]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def planes(values: np.ndarray) -> bytes:
    """The values byte by byte: first all lowest bytes, and so on, which compresses sorted values well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


class Unit:
    """Documents whose windows are hashed together."""

    def __init__(self):
        self.keys: list[tuple[int, int]] = []
        self.lengths: list[int] = []
        self.words: list[np.ndarray] = []
        self.size = 0

    def add(self, key1: int, key2: int, words: np.ndarray) -> None:
        self.keys.append((key1, key2))
        self.lengths.append(len(words))
        self.words.append(words)
        self.size += len(words)

    def rows(self, number: int, window: int, bits: int) -> Iterator[tuple]:
        """First the unit's directory and the windows known to repeat, in buckets below 0, then its hashes by bucket."""
        # Of the whole number: the first units of all partitions end in the same bits.
        aside = -1 - xxhash.xxh3_64_intdigest(number.to_bytes(8, "little")) % (1 << bits)
        ends = np.cumsum(self.lengths)
        directory = np.concatenate([np.asarray(self.keys, np.int64).ravel(), ends])
        yield aside, number, directory.tobytes(), None
        if self.size < window:
            return
        hashes = rolling(np.concatenate(self.words), window)
        starts = np.arange(len(hashes))
        whole = starts + window <= ends[np.searchsorted(ends, starts, "right")]
        hashes, starts = hashes[whole], starts[whole].astype(np.uint32)
        order = np.argsort(hashes, kind="stable")
        hashes, starts = hashes[order], starts[order]
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, len(hashes)))
        repeated = np.repeat(counts > 1, counts)
        yield aside, number, None, starts[repeated].tobytes()
        hashes, starts = hashes[first], np.where(counts > 1, np.uint32(0xFFFFFFFF), starts[first])
        edges = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        for bucket in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[bucket], edges[bucket + 1])
            yield bucket, number, planes(hashes[part]), planes(starts[part])


def _hashed(docs: DataFrame, window: int, bits: int, unit_words: int) -> DataFrame:
    """PACKED rows of `docs`, whose columns are key1, key2 and text."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, unit = WordHashes(), Unit()
        number = TaskContext.get().partitionId() << 31
        for batch in sliced(batches, 2):
            for key1, key2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                words = text.split() if text else []
                if len(words) >= window:
                    if len(known) > CACHE:
                        known.clear()
                    unit.add(key1, key2, np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
                if unit.size >= unit_words:
                    yield from packed(unit.rows(number, window, bits))
                    number, unit = number + 1, Unit()
        if unit.size:
            yield from packed(unit.rows(number, window, bits))

    def packed(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for some in batched(rows, 1024):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)

    schema = pa.schema([("bucket", pa.int32()), ("unit", pa.int64()), ("hashes", pa.binary()), ("places", pa.binary())])
    return docs.mapInArrow(hashed, PACKED)


def batched(rows: Iterator, size: int) -> Iterator[list]:
    some: list = []
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield some
            some = []
    if some:
        yield some


def _counted(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Of the hashes of one bucket, the places of those that more than one unit has; rows of buckets below 0 pass through."""
    if key[0] < 0:
        kinds = np.where(rows["places"].isna(), 0, 1)
        return pd.DataFrame({"unit": rows["unit"], "kind": kinds, "places": rows["places"].where(kinds == 1, rows["hashes"])})
    parts = [from_planes(data, np.uint64) for data in rows["hashes"]]
    hashes, units = np.concatenate(parts), np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    places = np.concatenate([from_planes(data, np.uint32) for data in rows["places"]])
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    repeated = np.zeros(len(hashes), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    repeated &= places != 0xFFFFFFFF
    units, places = units[repeated], places[repeated]
    if not len(units):
        return pd.DataFrame({"unit": np.zeros(0, np.int64), "kind": np.zeros(0, np.int32), "places": np.zeros(0, object)})
    cuts = np.flatnonzero(np.diff(units)) + 1
    firsts = units[np.concatenate([[0], cuts])]
    return pd.DataFrame({"unit": rows["unit"].to_numpy()[firsts], "kind": 1, "places": [p.tobytes() for p in np.split(places, cuts)]})


def _merged(key: tuple, rows: pd.DataFrame, window: int) -> pd.DataFrame:
    """The removal intervals of each document of one unit that has any, as start, end, start, end, ..."""
    directory = np.frombuffer(rows.loc[rows["kind"] == 0, "places"].iloc[0], np.int64)
    n = len(directory) // 3
    keys, ends = directory[: 2 * n].reshape(n, 2), directory[2 * n :]
    starts = np.sort(np.concatenate([np.frombuffer(data, np.uint32) for data in rows.loc[rows["kind"] == 1, "places"]] or [np.zeros(0, np.uint32)])).astype(np.int64)
    if not len(starts):
        return pd.DataFrame({"key1": np.zeros(0, np.int64), "key2": np.zeros(0, np.int64), "spans": np.zeros(0, object)})
    doc = np.searchsorted(ends, starts, "right")
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (starts[1:] > starts[:-1] + window) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(starts)) - 1
    doc, begin, end = doc[first], starts[first], starts[last] + window
    base = np.concatenate([[0], ends])[doc]
    spans = np.stack([begin - base, end - base], 1)
    cuts = np.flatnonzero(np.diff(doc)) + 1
    at = doc[np.concatenate([[0], cuts])]
    return pd.DataFrame({"key1": keys[at, 0], "key2": keys[at, 1], "spans": [s.ravel().tolist() for s in np.split(spans, cuts)]})


def repeated_spans(docs: DataFrame, window: int = WINDOW, unit_words: int = UNIT_WORDS, bits: int | None = None) -> DataFrame:
    """key1, key2 and the removal intervals of each different text of `docs` (key1, key2, text) that has any; the keys are two hashes of the text."""
    size = PACKED_BYTES * (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    if bits is None:
        bits = max(8, (4 * partitions - 1).bit_length(), (size // BUCKET_BYTES).bit_length())
    found = _hashed(docs, window, bits, unit_words).repartition(partitions, "bucket").groupBy("bucket").applyInPandas(_counted, FOUND)
    return found.groupBy("unit").applyInPandas(lambda key, rows: _merged(key, rows, window), SPANS).dropDuplicates(["key1", "key2"])


def keyed(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.withColumns({"key1": F.xxhash64(text_col), "key2": F.xxhash64(F.lit(7), text_col)})


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", unit_words: int = UNIT_WORDS, bits: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans (removed words, as start, end, start, end, ...) and kept (the other words joined by one space).

    A window is removed if its words also start anywhere else, in the same
    document or another. Null texts have no words; documents shorter than the
    window keep all. Repeated rows and ids keep one row each; as copies of each
    other, their windows are removed. Equal 64-bit hashes count as equal windows.
    Rows of `docs` must come in a fixed order within their partition, as from
    files or a checkpoint: units are numbered by it.
    """
    rows = keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text")
    spans = cut(repeated_spans(rows.select("key1", "key2", "text"), window, unit_words, bits))
    # Only texts that may have spans are shuffled. The key is made anew on both sides, so Spark may split the rows of a text that very many documents have.
    key = F.struct("key1", "key2").alias("key")
    asked = maybe_in(rows, F.col("key1"), spans, "key1")
    hit = asked.where("__maybe").select(key, "doc_id", "text").join(spans.select(key, "spans"), "key", "left").select("doc_id", "text", "spans")
    joined = asked.where("NOT __maybe").select("doc_id", "text", F.lit(None).cast("array<int>").alias("spans")).unionByName(hit)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            total, removed, kept = [], [], []
            for text, spans in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = text.split() if text else []
                total.append(len(words))
                for start, end in zip((spans or [])[-2::-2], (spans or [])[::-2], strict=True):
                    del words[start:end]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), batch.column(2), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "spans", "kept"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(cut_out, f"doc_id {kind}, n_words long, n_removed long, spans array<int>, kept string")


def op3_substring_dedup(spark, sf_dir):
    found = dedup_substrings(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), r AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY g) AS n FROM s) WHERE n > 1
), c AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM r
), n AS (SELECT rid, count(*) AS n_removed, list(p) AS ps FROM c GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN n USING (rid)
"""
