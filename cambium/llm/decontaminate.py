"""Benchmark decontamination with a generalised suffix automaton.

The automaton of the benchmark's word sequences is built once for each block of
items of bounded size and broadcast. Documents stream through it: after each
word its state holds the longest piece of any item that ends there, and with it
the windows of items that end there.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, read, sliced, utf8

WINDOW = 10
#: Items go to automata of at most about so many bytes of text, which bounds each broadcast.
BLOCK_BYTES = 4 << 20
#: A document more of whose words are hit than this share is dropped whole.
MAX_COVERAGE = 0.5

#: Digits, letters and all bytes of characters outside ASCII make words; A-Z is lower-cased.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class SuffixAutomaton:
    """All pieces of the items' word sequences, and the windows among them.

    A window is `window` consecutive words of an item; an item with fewer, but
    not none, is one window.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [0]
        self.length = [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        #: At the state of a window: its number of words and the items it is of.
        self.windows: list[dict[int, set[str]]] = [{} for _ in self.next]
        self.least = min((min(window, len(words)) for _, words in items if words), default=0)
        for item, words in items:
            size = min(window, len(words))
            for _, state, length in self.stream(words, size):
                if length == size:
                    self.windows[state].setdefault(size, set()).add(item)
        #: Of each state the nearest on the way up, itself included, that has windows; 0: none.
        self.above = [0] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.above[state] = state if self.windows[state] else self.above[self.link[state]]

    def _extend(self, last: int, word: bytes) -> int:
        """The state of the sequence that ended at `last`, one word longer."""
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new = self._add({}, self.length[last] + 1)
        at: int | None = last
        while at is not None and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at] if at else None
        if at is not None:
            target = self.next[at][word]
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, word, target)
        return new

    def _add(self, moves: dict[bytes, int], length: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1

    def _split(self, at: int, word: bytes, target: int) -> int:
        twin = self._add(dict(self.next[target]), self.length[at] + 1)
        self.link[twin], self.link[target] = self.link[target], twin
        while self.next[at].get(word) == target:
            self.next[at][word] = twin
            if not at:
                break
            at = self.link[at]
        return twin

    def stream(self, words: list[bytes], most: int | None = None) -> Iterator[tuple[int, int, int]]:
        """For each word after which at least the shortest window's words match: its place, the state and the longest matching length, up to `most`."""
        moves, link, longest, least = self.next, self.link, self.length, self.least
        state = length = 0
        for i, word in enumerate(words):
            to = moves[state].get(word)
            while to is None and state:
                state = link[state]
                length = longest[state]
                to = moves[state].get(word)
            if to is not None:
                state = to
                length += 1
                if most is not None and length > most:
                    length = most
                    while longest[link[state]] >= most:
                        state = link[state]
                if length >= least:
                    yield i, state, length

    def ending(self, state: int) -> list[tuple[int, set[str]]]:
        """Windows among the sequences of a state and of those that end it: one of each size at most, however many states are above."""
        found, at = [], self.above[state]
        while at:
            found += self.windows[at].items()
            at = self.above[self.link[at]]
        return found

    def spans(self, words: list[bytes]) -> tuple[list[list[int]], set[str], int]:
        """Merged spans of hit words (end exclusive), the items whose windows occur, and the longest match."""
        spans: list[list[int]] = []
        items: set[str] = set()
        most = 0
        for i, state, length in self.stream(words):
            ends = [(size, of) for size, of in self.ending(state) if size <= length]
            if ends:
                most = max(most, length)
                start = i + 1 - max(size for size, _ in ends)
                for _, of in ends:
                    items |= of
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
        return spans, items, most


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int, window: int = WINDOW) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of bounded size, one without items if there are none. Only this query set passes through the driver, block by block.

    An item larger than a block is cut into pieces that share `window` - 1
    words, which have its windows; only the longest match may then end at a cut.
    """
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    for item, text in benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).toLocalIterator():
        words = words_of((text or "").encode())
        pieces = [words]
        if text and len(text.encode()) > block_bytes:
            step = max(window, len(words) * block_bytes // len(text.encode()))
            pieces = [words[at : at + step + window - 1] for at in range(0, max(len(words) - window + 1, 1), step)]
        for piece in pieces:
            data = sum(map(len, piece)) + len(piece)
            if block and size + data > block_bytes:
                yield block
                block, size = [], 0
            size += data
            block.append((str(item), piece))
    yield block


class Block:
    """A block of items for tasks: its broadcast, and a name under which a worker keeps its automaton for the tasks that follow."""

    def __init__(self, docs: DataFrame, items: list):
        self.sent, self.name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def automaton(self, window: int) -> SuffixAutomaton:
        """Built once for each Python worker, which keeps the last one only."""
        if BUILT.get("of") != (self.name, window):
            BUILT.clear()
            BUILT.update(of=(self.name, window), automaton=SuffixAutomaton(self.sent.value, window))
        return BUILT["automaton"]


BUILT: dict = {}


def sent_blocks(docs: DataFrame, benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int, window: int = WINDOW) -> list[Block]:
    """All blocks for tasks; the driver holds one block of items at a time."""
    return [Block(docs, block) for block in item_blocks(benchmark, item_col, text_col, block_bytes, window)]


FOUND = "n_words long, spans array<array<int>>, items array<string>, longest int"


#: Of sorted `spans`: those that meet made one.
MERGED = """aggregate(spans, cast(array() AS array<array<int>>), (done, s) -> CASE
        WHEN size(done) > 0 AND element_at(done, -1)[1] >= s[0]
        THEN concat(slice(done, 1, size(done) - 1), array(array(element_at(done, -1)[0], greatest(element_at(done, -1)[1], s[1]))))
        ELSE concat(done, array(s)) END)"""


def _matched(docs: DataFrame, block: Block, window: int) -> DataFrame:
    """`docs`, whose last column is the text, with FOUND in its place."""
    types = [pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.string()), pa.int32()]
    names = [*docs.columns[:-1], "n_words", "spans", "items", "longest"]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = block.automaton(window)
        last = len(names) - 4
        for batch in sliced(batches, last):
            rows = []
            for text in utf8(batch.column(last)):
                words = words_of(text)
                spans, items, longest = automaton.spans(words)
                rows.append((len(words), spans, sorted(items), longest))
            added = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], *added], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return docs.mapInArrow(match, f"{schema}, {FOUND}")


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: doc_id, n_words, spans of hit words (merged; end exclusive), items (as strings, sorted) and the longest match.

    Null texts have no words; neither have texts without digits, letters or
    characters outside ASCII. Items without words have no windows; a benchmark
    without rows hits nothing. Equal items are each reported. Repeated rows and
    ids of `docs` keep one row each. Items beyond `block_bytes` go to further
    automata; then the rows found are merged by id and hash of the text.
    """
    blocks = sent_blocks(docs, benchmark, item_col, item_text_col, block_bytes, window)
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    if len(blocks) == 1:
        return _matched(chosen, blocks[0], window).drop("key")
    hits = None
    for block in blocks:
        one = _matched(chosen, block, window).where(F.size("spans") > 0).drop("n_words").dropDuplicates(["doc_id", "key"])
        hits = one if hits is None else hits.unionByName(one)
    merged = hits.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max("longest").alias("longest"),
    )
    words = _matched(chosen, Block(docs, []), window).select("doc_id", "key", "n_words")
    return words.join(merged, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left").select(
        "doc_id",
        "n_words",
        F.coalesce(F.expr(MERGED), F.expr("cast(array() AS array<array<int>>)")).alias("spans"),
        F.coalesce("items", F.expr("cast(array() AS array<string>)")).alias("items"),
        F.coalesce("longest", F.lit(0)).alias("longest"),
    )


def without(text: bytes, spans: list[list[int]]) -> bytes:
    """The text without these words, whatever stands between them included."""
    places = [m.span() for m in WORD.finditer(text)]
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*kept, text[at:]])


def covered(spans: list[list[int]], words: int, total: int, max_coverage: float) -> bool:
    """Whether too few of `total` words are left once the spans of the `words` that are still there go."""
    return words - sum(end - start for start, end in spans) < (1 - max_coverage) * total


def remove_spans(text: bytes, automaton: SuffixAutomaton, max_coverage: float) -> bytes | None:
    """The text without its hit words; None if too many words are hit.

    Cutting joins the words at both sides, so what is left is looked at again
    until nothing is hit.
    """
    total = None
    while True:
        words = words_of(text)
        spans, _, _ = automaton.spans(words)
        total = len(words) if total is None else total
        if not spans:
            return text
        if covered(spans, len(words), total, max_coverage):
            return None
        text = without(text, spans)


def _cleaned(texts: DataFrame, blocks: list, window: int, max_coverage: float) -> DataFrame | None:
    """key1, key2 (two hashes of the text) and cleaned (null if the text goes) of each different text of `texts` (key1, key2, text) that any block hits.

    As remove_spans() does, but the spans of all blocks are found on the same
    text and merged before any is cut.
    """
    keys = ["key1", "key2"]

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 3):
            key1, key2, totals, _, found = batch.columns
            outs, words = [], []
            for total, text, spans in zip(totals.to_pylist(), utf8(batch.column(3)), found.to_pylist(), strict=True):
                n = len(words_of(text))
                words.append(n if total is None else total)
                outs.append(None if covered(spans, n, words[-1], max_coverage) else without(text, spans).decode())
            yield pa.RecordBatch.from_arrays([key1, key2, pa.array(words, pa.int64()), pa.array(outs, pa.string())], [*keys, "total", "text"])

    now, rounds = texts.select(*keys, F.lit(None).cast("long").alias("total"), "text"), []
    while True:
        hits = None
        for block in blocks:
            one = _matched(now.select(*keys, "text"), block, window).where(F.size("spans") > 0).select(*keys, "spans").dropDuplicates(keys)
            hits = one if hits is None else hits.unionByName(one)
        spans = hits.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")).select(*keys, F.expr(MERGED).alias("spans"))
        hit = now.join(spans, keys).dropDuplicates(keys).select(*keys, "total", "text", "spans")
        after = cut(hit.mapInArrow(cut_out, "key1 long, key2 long, total long, text string"))
        if after.isEmpty():
            break
        rounds.append(after.select(*keys, F.struct(F.lit(len(rounds)).alias("round"), F.col("text").alias("cleaned")).alias("last")))
        now = after.where("text IS NOT NULL")
    if not rounds:
        return None
    every = rounds[0]
    for other in rounds[1:]:
        every = every.unionByName(other)
    return every.groupBy(*keys).agg(F.max_by("last", "last.round").alias("last")).select(*keys, "last.cleaned")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """`docs` without the words that windows of the benchmark cover, and without documents more of whose words they cover than `max_coverage`.

    All other rows and columns stay as they are, null texts included. The
    result doesn't depend on how items fall into blocks.
    """
    at = docs.columns.index(text_col)
    blocks = sent_blocks(docs, benchmark, item_col, item_text_col, block_bytes, window)
    if len(blocks) > 1:
        text = F.col(text_col)
        keys = F.xxhash64(text).alias("key1"), F.xxhash64(F.lit(7), text).alias("key2")
        found = _cleaned(docs.where(text.isNotNull()).select(*keys, text.alias("text")), blocks, window, max_coverage)
        if found is None:
            return docs
        found = found.select(F.col("key1").alias("__key1"), F.col("key2").alias("__key2"), F.col("cleaned").alias("__cleaned"), F.lit(True).alias("__hit"))
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
        marked = docs.select(row, keys[0].alias("__at1"), keys[1].alias("__at2")).join(found, (F.col("__at1") == F.col("__key1")) & (F.col("__at2") == F.col("__key2")), "left")
        left = marked.where(F.col("__hit").isNull() | F.col("__cleaned").isNotNull())
        new = {text_col: F.when(F.col("__hit"), F.col("__cleaned")).otherwise(F.col(f"__row.`{text_col}`")).alias(text_col)}
        return left.select(*[new.get(c, F.col(f"__row.`{c}`")) for c in docs.columns])
    block = blocks[0]

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = block.automaton(window)
        for batch in sliced(batches, at):
            texts, stays = [], []
            for text in utf8(batch.column(at)):
                out = remove_spans(text, automaton, max_coverage) if text else text
                stays.append(out is not None or text is None)
                texts.append(None if out is None else out.decode())
            columns = [*batch.columns]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def op1_decontamination(spark, sf_dir):
    found = find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.expr("aggregate(spans, 0L, (n, s) -> n + s[1] - s[0])").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bs AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM bs)
), ks AS (SELECT DISTINCT k FROM bw
), dw AS (
  SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks)
), h AS (SELECT rid, k, i, item_id FROM dw JOIN bw USING (k, g)
), n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT rid, k, i FROM h)) GROUP BY rid
), m AS (
  SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)
"""
