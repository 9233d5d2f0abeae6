"""Packing of tokenised documents into sequences of a fixed length.

Pieces as long as a sequence fill one alone. The others, at most one per
document, are dealt at random into shards of bounded size; each shard is filled
best-fit and then improved by local search until no exchange helps. The bins
that a shard leaves open meet those of many other shards in a second, small
round.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, read, sliced

CAPACITY = 4096
END_ID = 1
#: Pieces to a shard of the first round.
SHARD_ROWS = 4096
#: Shards of the first round whose open bins meet in one of the second.
FAN_IN = 32
#: Chunks of text, and words, whose ids a Python worker remembers.
CACHE = 60_000

#: Bins at least so full stay as the first round left them.
CLOSED = 0.98

#: After doc_id.
PIECES = "piece int, start long, length long, ids_crc32 long, deal long, sequence_id long, offset long, fill long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ChunkIds(dict):
    """Token ids, as little-endian unsigned 32-bit bytes, of chunks of text.

    This vocabulary's normalizer and pattern never join characters across
    ASCII white space, so a text's ids are those of its chunks one after another.
    A chunk of letters and then ASCII punctuation is encoded as those two, by a
    faster implementation of the same merges: the vocabulary's ids are in the
    order of its merges, and the end of a word is a byte that UTF-8 doesn't
    have. It looks merges up by their result only, so a word whose tokens
    include one that its own listed merges don't make is left to the tokenizer
    itself, as are all other chunks.
    """

    SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
    END = b"\xff"

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        byte = byte_letters()

        def data(token: str) -> bytes:
            word = token.removesuffix("</w>")
            return bytes(byte[c] for c in word) + self.END * (word != token)

        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {data(token): i for token, i in model["vocab"].items() if token not in special}
        ranks[self.END] = max(ranks.values()) + 1
        listed = {tuple(map(data, pair)) for pair in model["merges"]} | {(bytes([b]), self.END) for b in range(255)}
        self.fast = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.unsure = {i for piece, i in ranks.items() if not self._made(piece, ranks, listed)}

    @staticmethod
    def _made(piece: bytes, ranks: dict[bytes, int], listed: set[tuple[bytes, bytes]]) -> bool:
        """Whether merging by rank makes this token by listed merges only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((ranks.get(a + b, len(ranks) + 1), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if (parts[i], parts[i + 1]) not in listed:
                return False
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return True

    def __missing__(self, chunk: str) -> bytes:
        if m := self.SIMPLE.fullmatch(chunk):
            ids = self.fast(m[1].lower().encode() + self.END)
            if m[2]:
                ids += self.fast(m[2].encode() + self.END)
        if not m or not self.unsure.isdisjoint(ids):
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        self[chunk] = found = array("I", ids).tobytes()
        return found

    def of(self, text: str) -> bytes:
        if len(self) > CACHE:
            self.clear()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@cache
def chunk_ids(path: str) -> ChunkIds:
    """One for each Python worker, which many tasks use one after another."""
    return ChunkIds(path)


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents, with `deal`, a random number of the document; those as long as `capacity` have a sequence, numbered below 0."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = chunk_ids(tokenizer), np.asarray([end_id], "<u4").tobytes()
        full, mark = 0, TaskContext.get().partitionId() << 33
        for batch in sliced(batches, 1):
            out = []
            for doc_id, text, deal in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = ids_of.of(text or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    placed = (0, 0, 0)
                    if len(part) == 4 * capacity:
                        placed, full = (-1 - (mark + full), 0, capacity), full + 1
                    out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), deal, *placed))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.monotonically_increasing_id()).alias("deal"))
    fields = [(x.split()[0], pa.int32() if x.endswith("int") else pa.int64()) for x in PIECES.split(", ")]
    schema = pa.schema([("doc_id", to_arrow_type(chosen.schema["doc_id"].dataType)), *fields])
    return chosen.mapInArrow(cut_up, piece_schema(chosen))


def piece_schema(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PIECES}"


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indexes: the longest piece first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    open_at: dict[int, list[int]] = {}
    gaps: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = bisect_left(gaps, size)
        if at == len(gaps):
            chosen, gap = len(bins), capacity
            bins.append([])
        else:
            gap = gaps[at]
            chosen = open_at[gap].pop()
            if not open_at[gap]:
                gaps.pop(at)
        bins[chosen].append(i)
        if gap > size:
            if not open_at.setdefault(gap - size, []):
                insort(gaps, gap - size)
            open_at[gap - size].append(chosen)
    return bins


class Bins:
    """Pieces in bins, as arrays, so that one step looks at all takers at once."""

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int):
        self.size = lengths.astype(np.int64)
        self.of = np.zeros(len(lengths), np.int64)
        for k, members in enumerate(bins):
            self.of[members] = k
        self.fill = np.bincount(self.of, self.size, len(bins)).astype(np.int64)
        self.capacity = capacity
        self.by_bin: np.ndarray | None = None

    def put(self, piece: int, to: int) -> None:
        self.fill[self.of[piece]] -= self.size[piece]
        self.fill[to] += self.size[piece]
        self.of[piece] = to
        self.by_bin = None

    def give(self, piece: int) -> bool:
        """Move a piece to another bin, or exchange it there for one or two that are shorter; False if no bin can take it.

        The squared fills grow: the taker is at least as full as the giver.
        """
        giver, given = self.of[piece], self.size[piece]
        takes = (self.fill >= self.fill[giver]) & (self.fill < self.capacity)
        takes[giver] = False
        room = np.where(takes, self.capacity - self.fill, 0)
        fits = np.flatnonzero(room >= given)
        if len(fits):
            self.put(piece, int(fits[np.argmin(room[fits])]))
            return True
        least = given - room[self.of]
        one = np.flatnonzero((self.size < given) & (self.size >= least))
        if len(one):
            back = [int(one[np.argmin(self.size[one])])]
        elif not (back := self._two(given, least)):
            return False
        taker = int(self.of[back[0]])
        for other in back:
            self.put(other, int(giver))
        self.put(piece, taker)
        return True

    def _two(self, given: int, least: np.ndarray) -> list[int]:
        """Two pieces of one bin that together are shorter than `given` and leave room for it."""
        if self.by_bin is None:
            self.by_bin = np.lexsort((self.size, self.of))
        order, span = self.by_bin, self.capacity + 1
        place = self.of[order] * span + self.size[order]
        first = np.flatnonzero((least[order] < given) & (self.size[order] < given))
        # The shortest partner in the same bin, other than the piece itself.
        at = np.searchsorted(place, self.of[order[first]] * span + np.maximum(least[order[first]] - self.size[order[first]], 0))
        at += at == first
        inside = at < len(order)
        first, at = first[inside], at[inside]
        both = self.size[order[first]] + self.size[order[at]]
        fits = np.flatnonzero((self.of[order[first]] == self.of[order[at]]) & (both < given))
        if not len(fits):
            return []
        k = fits[np.argmin(both[fits])]
        return [int(order[first[k]]), int(order[at[k]])]


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Moves and exchanges between underfull bins, each of which increases the sum of squared fills, until no bin empties any more.

    The emptiest bin gives, its longest piece first: a piece moves to the
    fullest bin with room for it, or is exchanged for a shorter one, or for two
    that are shorter together. The search ends at the least number of bins that
    can hold all, or when a pass over all underfull bins changes nothing; as
    squared fills only grow, it ends.
    """
    if not bins:
        return bins
    packed = Bins(bins, lengths, capacity)
    least = -(-int(packed.size.sum()) // capacity)
    changed = True
    while changed and np.count_nonzero(packed.fill) > least:
        changed = False
        under = np.flatnonzero((packed.fill > 0) & (packed.fill < capacity))
        for giver in under[np.argsort(packed.fill[under], kind="stable")].tolist():
            given = True
            while given and packed.fill[giver]:
                members = np.flatnonzero(packed.of == giver)
                given = any(packed.give(int(i)) for i in members[np.argsort(-packed.size[members], kind="stable")])
                changed |= given
            if np.count_nonzero(packed.fill) == least:
                break
    left: dict[int, list[int]] = {}
    for i, k in enumerate(packed.of.tolist()):
        left.setdefault(k, []).append(i)
    return list(left.values())


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece of each document.

    A document is its ids and then `end_id`; null texts are empty, so an empty
    document is one token. Documents longer than `capacity` are cut into pieces
    of that length, the last of which may be shorter. Repeated ids and rows are
    packed as often as they occur; ids may be of any type, and null. An empty
    table gives an empty result.

    The search within a shard has no limit. What shards leave: a bin of at
    least CLOSED of the capacity isn't looked at again after the first round.
    """
    # Written, so that pieces are dealt alike whatever is computed again.
    pieces = cut(pieces_of(docs, tokenizer or default_tokenizer(), capacity, end_id, id_col, text_col))
    rest = pieces.where(F.col("fill") < capacity)
    shard = F.pmod("deal", F.lit(max(1, rest.count() // SHARD_ROWS)))

    def packed(rows: pa.Table, number: int) -> pa.Table:
        rows = rows.take(pa.array(np.lexsort((rows["piece"].to_numpy(), rows["deal"].to_numpy()))))
        lengths = rows["length"].to_numpy()
        placed = np.zeros((3, len(lengths)), np.int64)
        for k, members in enumerate(pack_lengths(lengths, capacity)):
            ends = np.cumsum(lengths[members])
            placed[0, members], placed[1, members], placed[2, members] = (number << 32) + k, ends - lengths[members], ends[-1]
        for name, column in zip(("sequence_id", "offset", "fill"), placed, strict=True):
            rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array(column))
        return rows

    def first(key: tuple, rows: pa.Table) -> pa.Table:
        return packed(rows, key[0].as_py())

    def second(key: tuple, rows: pa.Table) -> pa.Table:
        return packed(rows, (1 << 30) + key[0].as_py())

    schema = piece_schema(pieces)
    filled = cut(rest.groupBy(shard.alias("shard")).applyInArrow(first, schema))
    closed = F.col("fill") >= CLOSED * capacity
    met = filled.where(~closed).groupBy(F.floor(shard / FAN_IN).alias("meeting")).applyInArrow(second, schema)
    return pieces.where(F.col("fill") == capacity).unionByName(filled.where(closed)).unionByName(met).drop("deal", "fill")


def op2_best_fit_packing(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents"))
