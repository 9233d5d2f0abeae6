"""Toxicity scores of text that may be disguised.

A character model counted over all documents drives a Viterbi search through
the lattice of what each token may stand for: leetspeak, letters spaced or
pointed apart (a space between single letters is nothing or the end of a word),
and repetition. The restored words then carry evidence learned from labelled
documents, and a small logistic model turns a document's strongest evidence
into a score.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_LOWER, cut, fresh, read, sliced, utf8

#: Labelled documents that the weights are learned from, at most; those whose hashed ids are smallest.
MAX_TRAIN = 20_000
THRESHOLD = 0.3
#: Imaginary documents, in the usual proportion of toxic ones, that each feature is also in.
PRIOR_DOCS = 3.0
#: Feature or word counts held by a task before it sends them on; words whose weights a task remembers.
HELD = 120_000

#: The letters that a digit or symbol may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "!": "i", "$": "s", "(": "c", "+": "t", "@": "a", "|": "il", "€": "e", "£": "l",
}
LETTERS = "a-zß-öø-ÿœ"
LETTER = re.compile(f"[{LETTERS}]")
PLAIN = re.compile(f"[{LETTERS}]+")
DOUBLE, TRIPLE = re.compile(r"(.)\1"), re.compile(r"(.)\1\1")
READABLE = re.compile(f"[{LETTERS}{re.escape(''.join(LEET))}]")
RUN = re.compile(r"(?s)(.)\1*")
EDGES = re.compile(f"^[^{LETTERS}]+|[^{LETTERS}]+$")
#: Three or more symbols after a word that stand for no letter.
NOISE_AFTER = re.compile(rf"(?<=\w)[^\w{re.escape(''.join(LEET))}]{{3,}}$")
MARKS_AFTER, MARKS_BEFORE = ".,;:!?'\")]}»…", "'\"([{«¿¡"
#: Logarithms of the chance of a symbol that no letters explain, and of one in a number.
UNREADABLE, IN_NUMBER = -8.0, -math.log(10)
#: Cost of a word's end between single letters.
BREAK = 0.5

#: Of bytes, only a-z and those above 0x7F (A-Z lower-cased); the rest part words.
LETTER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


@dataclass
class Model:
    """What scoring needs; its size is bounded by the alphabet and by the words of MAX_TRAIN documents."""

    grams: dict[str, float] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    #: Of the strongest word, the second, the sum of the strongest five, the logarithm of the number of words, and 1.
    coefficients: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0, 0.0, -20.0])


def gram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """gram, n: how often three letters follow each other in the words of all documents; ^ and $ are a word's ends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        grams: Counter[str] = Counter()

        def turn() -> None:
            for word, n in words.items():
                text = word.decode(errors="replace").lower()
                if PLAIN.fullmatch(text):
                    text = f"^^{text}$"
                    for i in range(len(text) - 2):
                        grams[text[i : i + 3]] += n
            words.clear()

        for batch in sliced(batches, 0):
            for text in utf8(batch.column(0)):
                if text:
                    words.update(text.translate(LETTER_BYTES).split())
                if len(words) > HELD:
                    turn()
        turn()
        yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["gram", "n"])

    return docs.select(text_col).mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def log_probabilities(counts: dict[str, int]) -> dict[str, float]:
    """Of each third letter after two, with those of two letters alone for what is unseen."""
    total: dict[str, int] = defaultdict(int)
    for gram, n in counts.items():
        total[gram[:2]] += n
    return {gram: math.log((n + 0.1) / (total[gram[:2]] + 6)) for gram, n in counts.items()} | {two: math.log(0.1 / (n + 6)) for two, n in total.items()}


@lru_cache(4096)
def options(symbol: str, count: int) -> list[tuple[str, float]]:
    """What a run of one symbol may stand for, and the cost of each reading."""
    if LETTER.match(symbol):
        if count == 1:
            return [(symbol, 0.0)]
        return [(symbol * 2, 0.0 if count == 2 else 0.7), (symbol, 2.0 if count == 2 else 0.5)]
    if symbol in LEET:
        read_as = [(letter, 1.0) for letter in LEET[symbol]] + ([(letter * 2, 1.0) for letter in LEET[symbol]] if count > 1 else [])
        return read_as if symbol.isdigit() else [*read_as, ("", 1.2)]
    return [("", 0.0), (" ", BREAK)] if symbol == " " else [("", 0.5)]


def chance(grams: dict[str, float], two: str, letter: str) -> float:
    """The logarithm of a letter's chance after two others."""
    return grams.get(two + letter) or grams.get(two, UNREADABLE)


def restore(token: str, grams: dict[str, float]) -> tuple[str, float]:
    """The likeliest reading of a token, words parted by a space, and its score: Viterbi over its runs of symbols; a state is the last two letters."""
    known = grams.get
    states: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
    for m in RUN.finditer(token):
        after: dict[str, tuple[float, tuple | None]] = {}
        for letters, cost in options(m[1], len(m[0])):
            for state, (score, text) in states.items():
                now, at = score - cost, state
                for letter in letters:
                    if letter == " ":
                        now += known(at + "$") or known(at, UNREADABLE)
                        at = "^^"
                    else:
                        now += known(at + letter) or known(at, UNREADABLE)
                        at = at[1] + letter
                found = after.get(at)
                if found is None or found[0] < now:
                    after[at] = (now, (text, letters) if letters else text)
        states = after
    best, text = max(((score + chance(grams, at, "$"), text) for at, (score, text) in states.items()), key=lambda found: found[0])
    parts = []
    while text:
        text, letters = text
        parts.append(letters)
    return "".join(reversed(parts)), best


def undoubled(token: str, grams: dict[str, float]) -> str:
    """restore() of a token of letters of which one is doubled: its lattice has two paths, which differ in three chances only."""
    at = DOUBLE.search(token).start() + 2
    padded = f"^^{token}$"
    before, letter, after = padded[at - 1], padded[at], padded[at + 2]
    (_, double), (_, single) = options(letter, 2)
    literal = chance(grams, before + letter, letter) + chance(grams, letter + letter, after) - double
    return token[: at - 2] + token[at - 1 :] if chance(grams, before + letter, after) - single > literal else token


def literal_score(token: str, grams: dict[str, float]) -> float:
    """Of the token as it stands: letters by the character model, other symbols as part of a number if there are no letters."""
    if not LETTER.search(token):
        return IN_NUMBER * len(token)
    score, at = 0.0, "^^"
    for symbol in token:
        score += chance(grams, at, symbol) if LETTER.match(symbol) else UNREADABLE
        at = at[1] + symbol
    return score + chance(grams, at, "$")


def readings(token: str, grams: dict[str, float]) -> list[str]:
    """The words a token may stand for: its letters as they are, and the restored words if they are likelier than the token as it stands.

    Marks at either end are punctuation. A token of letters none of which is
    doubled has one path through the lattice only.
    """
    if not token.isalpha():
        token = NOISE_AFTER.sub("", token).lstrip(MARKS_BEFORE).rstrip(MARKS_AFTER)
    if PLAIN.fullmatch(token):
        doubled = DOUBLE.findall(token)
        if not doubled:
            return [token]
        if len(doubled) == 1 and not TRIPLE.search(token):
            restored = undoubled(token, grams)
            return [token] if restored == token else [token, restored]
    if not READABLE.search(token):
        return []
    restored, score = restore(token, grams)
    bare = EDGES.sub("", token)
    literal = [bare] if bare and " " not in bare else []
    return [*literal, *restored.split()] if score > literal_score(token, grams) or restored == token else literal


def features(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return [f"{word}$", *(word[:k] for k in (4, 5, 6) if len(word) >= k)]


class Words(dict):
    """The readings' features of each token."""

    def __init__(self, grams: dict[str, float]):
        super().__init__()
        self.grams = grams

    def __missing__(self, token: bytes) -> tuple[str, ...]:
        found = {f for word in readings(token.decode(errors="replace").lower(), self.grams) for f in features(word)}
        self[token] = found = tuple(found)
        return found


class Evidence(dict):
    """The largest weight among the features of each token, of those above 0."""

    def __init__(self, grams: dict[str, float], weights: dict[str, float]):
        super().__init__()
        self.grams, self.weights = grams, weights

    def __missing__(self, token: bytes) -> float:
        weight, found = self.weights.get, 0.0
        for word in readings(token.decode(errors="replace").lower(), self.grams):
            found = max(found, weight(word + "$", 0.0))
            if len(word) > 3:
                found = max(found, weight(word[:4], 0.0), weight(word[:5], 0.0) if len(word) > 4 else 0.0, weight(word[:6], 0.0) if len(word) > 5 else 0.0)
        self[token] = found
        return found


def tokens_of(text: bytes) -> set[bytes]:
    """The different tokens of a text; at least three single characters in a row are also one token, with the spaces between them."""
    words = text.translate(ASCII_LOWER).split()
    tokens = set(words)
    if sum(len(t) == 1 for t in tokens) > 2 or (any(len(t) == 1 for t in tokens) and sum(len(w) == 1 for w in words) > 2):
        run: list[bytes] = []
        for word in [*words, b"  "]:
            if len(word) == 1:
                run.append(word)
            else:
                if len(run) > 2:
                    tokens.add(b" ".join(run))
                run = []
    return tokens


def described(text: bytes | None, evidence: Evidence) -> list[float]:
    if len(evidence) > HELD:
        evidence.clear()
    tokens = tokens_of(text or b"")
    best = heapq.nlargest(5, map(evidence.__getitem__, tokens))
    best += [0.0] * (5 - len(best))
    return [best[0], best[1], sum(best), math.log1p(len(tokens)), 1.0]


def held_out(id_col: str):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """text, toxic and half (0 or 1) of at most `max_train` labelled documents that aren't held out, written once; of rows of one id, one text."""
    chosen = (
        labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__toxic"))
        .where(F.col("__id").isNotNull() & F.col("__toxic").isin(0, 1) & ~held_out("__id"))
        .groupBy("__id").agg(F.max("__toxic").alias("__toxic"))
        .orderBy(F.xxhash64("__id"), "__id").limit(max_train)
    )
    # At most max_train rows, so they may be broadcast.
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    one = rows.groupBy("__id", "__toxic").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text"))
    return cut(one.select("text", F.col("__toxic").alias("toxic"), F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(2)).cast("int").alias("half")))


def feature_counts(rows: DataFrame, grams: dict[str, float]) -> DataFrame:
    """feature and the number of documents that have it, clean and toxic, of either half."""
    sent = rows.sparkSession.sparkContext.broadcast(grams)
    names = ["n00", "n01", "n10", "n11"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, found = Words(sent.value), defaultdict(lambda: [0, 0, 0, 0])

        def packed() -> pa.RecordBatch:
            columns = [pa.array([n[i] for n in found.values()], pa.int64()) for i in range(4)]
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *columns], ["feature", *names])

        for batch in sliced(batches, 0):
            for text, toxic, half in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for feature in {f for token in tokens_of(text or b"") for f in words[token]}:
                    found[feature][2 * half + toxic] += 1
                if len(words) > HELD:
                    words.clear()
                if len(found) > HELD:
                    yield packed()
                    found.clear()
        yield packed()

    counted = rows.mapInArrow(count, "feature string, " + ", ".join(f"{n} long" for n in names))
    return counted.groupBy("feature").agg(*[F.sum(n).alias(n) for n in names])


def weight(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """The logarithm of how much likelier a document with the feature is toxic."""
    return np.log((toxic + PRIOR_DOCS * share) / (clean + PRIOR_DOCS * (1 - share))) - math.log(share / (1 - share))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    """Coefficients by Newton's method; the last column is constant and isn't shrunk."""
    w, shrink = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink + 1e-9 * np.eye(len(w)), x.T @ (p - y) + shrink @ w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Count the character model over all documents, and learn weights from a bounded sample of labelled ones.

    What comes to the driver is bounded: three-letter counts by the alphabet,
    features and described documents by `max_train`. The logistic model sees
    each half's documents with weights of the other half. Without labelled
    documents of both kinds every score is almost 0. Null labels and ids count
    as none; an id labelled both ways is toxic.
    """
    grams = log_probabilities({r["gram"]: r["n"] for r in gram_counts(docs, text_col).toLocalIterator()})
    rows = training_rows(docs, labels, max_train, id_col, text_col, label_col)
    sizes = {(r["half"], r["toxic"]): r["n"] for r in rows.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = (sum(n for (_, t), n in sizes.items() if t == kind) for kind in (1, 0))
    if not toxic or not clean:
        return Model(grams)
    share = toxic / (toxic + clean)
    both, odds = F.col("n01") + F.col("n11"), PRIOR_DOCS * (1 - share)
    ratio = (both + PRIOR_DOCS * share) / (F.col("n00") + F.col("n10") + odds)
    top = feature_counts(rows, grams).where(both >= 2).where(ratio > 2 * share / (1 - share)).orderBy("feature").collect()
    n = np.asarray([[r["n00"], r["n01"], r["n10"], r["n11"]] for r in top], float).reshape(len(top), 4)
    names = [r["feature"] for r in top]

    def weights(of: np.ndarray) -> dict[str, float]:
        return {f: w for f, w in zip(names, of.tolist(), strict=True) if w > 0}

    halves = [weights(weight(n[:, 2 * h + 1], n[:, 2 * h], share)) for h in (0, 1)]
    sent = docs.sparkSession.sparkContext.broadcast((grams, halves))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, halves = sent.value
        evidence = [Evidence(grams, halves[1]), Evidence(grams, halves[0])]
        for batch in sliced(batches, 0):
            x = [described(t, evidence[h]) for t, h in zip(utf8(batch.column(0)), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    seen = rows.mapInArrow(describe, "x array<double>, toxic int").collect()
    x, y = np.asarray([r["x"] for r in seen]), np.asarray([r["toxic"] for r in seen], float)
    return Model(grams, weights(weight(n[:, 1] + n[:, 3], n[:, 0] + n[:, 2], share)), logistic(x, y).tolist())


def _judged(docs: DataFrame, model: Model, text_col: str, threshold: float, names: list[str]) -> DataFrame:
    """`docs` with the score and the prediction added under these names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        evidence, w = Evidence(model.grams, model.weights), np.asarray(model.coefficients)
        for batch in sliced(batches, at):
            x = np.asarray([described(t, evidence) for t in utf8(batch.column(at))]).reshape(-1, len(w))
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            added = [pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names])

    return docs.mapInArrow(judge, schema)


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with the columns score and predicted added, or replaced; null texts are scored as empty ones. Repeated rows keep one row each."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    return _judged(docs.select(*kept), model, text_col, threshold, ["score", "predicted"])


def drop_toxic(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that aren't predicted toxic, with all their columns as they are, whatever their names."""
    names = [fresh(docs.columns, name) for name in ("score", "predicted")]
    judged = _judged(docs, fit(docs, labels, max_train, id_col=id_col, text_col=text_col), text_col, THRESHOLD, names)
    return judged.where(F.col(names[1]) == 0).drop(*names)


def op6_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
