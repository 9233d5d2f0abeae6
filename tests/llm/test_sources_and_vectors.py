"""Hard negatives, source divergence and source mixing against brute force: nulls, ties, repeats, empty tables, extra columns, hot groups."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import pytest
from pyspark.sql import functions as F

from cambium.llm import common, divergence, hard_negatives, mixing

ROW = "vec_id long, label int, embedding array<float>, id long, vector string, key int, w long, cell long, rank int"
EXTRA = (1, "v", 2, 3, 4, 5)


def brute_mine(rows, every=100, positives=5, negatives=10):
    usable = [(i, l, [floor(256 * float(x)) for x in v]) for i, l, v in rows if l is not None and v is not None and all(x is not None and abs(x) < float("inf") for x in v)]
    order = lambda r: (-r[1], r[0] is None, r[0])
    out = []
    for at, (i, l, v) in enumerate(usable):
        if i is None or i % every:
            continue
        others = [(j, sum(a * b for a, b in zip(v, u)), k == l) for n, (j, k, u) in enumerate(usable) if n != at]
        for p, ps, _ in sorted([o for o in others if o[2]], key=order)[:positives]:
            fit = sorted([o for o in others if not o[2] and 30 * ps <= 100 * o[1] <= 90 * ps], key=order)[:negatives]
            out += [(i, p, r, n, ps, ns) for r, (n, ns, _) in enumerate(fit, 1)]
    return Counter(out)


def mined(spark, rows, every=100, **options):
    df = spark.createDataFrame([(i, l, v, *EXTRA) for i, l, v in rows], ROW).repartition(3)
    got = hard_negatives.mine(df, F.col("id") % every == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(map(tuple, got.collect()))


def vectors(n, dim, seed, spread=1.0):
    rng = random.Random(seed)
    return [[rng.gauss(0, spread) for _ in range(dim)] for _ in range(n)]


def test_hard_negatives_many_cells(spark):
    """32 cells and one; a third of all rows are equal."""
    made = vectors(600, 6, 1)
    made += [made[0]] * 300
    rows = [(i, i % 4, v) for i, v in enumerate(made)]
    want = brute_mine(rows, 20)
    assert mined(spark, rows, 20, cell_rows=30) == want
    assert mined(spark, rows, 20) == want and len(want) > 500


def test_hard_negatives_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    near = [[0.5, 0.25, 0.1], [0.5, 0.25, 0.0999], [0.45, 0.2, 0.1], [0.3, 0.3, 0.3], [-0.5, 0.1, 0.0], [0.0, 0.0, 0.0]]
    rows = [(i, i % 3, near[i % len(near)]) for i in range(60)]
    rows += [(100, None, near[0]), (200, 1, None), (300, 1, [0.1, None, 0.2]), (400, 1, [nan, 0.1, 0.2]), (500, 1, [inf, 0.1, 0.2]), (600, 1, []), (700, 1, [0.4]), (800, 2, [0.1, 0.2, 0.3, 0.4]), (None, 1, near[2]), (None, 0, near[1]), (0, 0, near[0]), (0, 0, near[0]), (900, 7, near[3])]
    want = brute_mine(rows)
    got = mined(spark, rows)
    assert got == want and {a for a, *_ in got} >= {0, 800}
    assert not mined(spark, []) and not mined(spark, [(0, 1, [0.5, 0.5])])


def test_hard_negatives_tree_bounds():
    """A leaf is scored only if the annulus meets it, and nothing is lost by that."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = np.floor(rng.normal(0, 60, (4000, 3)))
    sphere = hard_negatives.Sphere((rows**2).sum(1).max())
    tree = hard_negatives.Tree(np.arange(4000), np.arange(4000) % 2, rows, sphere)
    seen = 0
    for at in range(20):
        scores = (rows @ rows[at]).astype(int)
        high = int(scores.max() * 0.6)
        want = sorted((-int(s), i) for i, s in enumerate(scores) if i % 2 and 0 <= s <= high)[:7]
        assert [(-s, i) for _, s, i in tree.search(rows[at], 1, [(0, 0, high, -(1 << 63))], True, 7)] == want
        seen += len(want)
    assert seen == 140 and len(tree.leaves) > 30


DOC = "doc_id long, text string, lang string, source string, n long, term string, value string, p double, total long, size long, rank long, place long"
MORE = (1, "t", "v", 0.5, 2, 3, 4, 5)


def odd_docs():
    rng = random.Random(5)
    vocabulary = ["alpha", "beta", "Gamma", "delta", "épée", "日本", "zeta's", "x1y2", "ÉCOLE"]
    rows = [(i, " ".join(rng.choices(vocabulary[: 4 + i % 6], k=rng.randint(0, 40))), ["en", "de", None, ""][i % 4], rng.choice(["a", "b", "ü", "z", None, ""])) for i in range(120)]
    rows += [(3, rows[3][1], rows[3][2], rows[3][3]), (None, "alpha " * 5000, "en", "a"), (None, None, "fr", None), (500, "", "xx", "only"), (501, "12 34 --", "yy", "one"), (502, "unseen words", "yy", "two"), (503, "alpha\x00beta\x1cgamma\x7fdelta", "en", "b")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *MORE) for r in odd_docs()], DOC).repartition(4)


def brute_audit(rows, min_docs, top):
    seen, counts, groups = defaultdict(int), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang, source].update(words)
        for term in set(words):
            seen[lang, term] += 1
    out = Counter()
    for lang in {g[0] for g in groups}:
        terms = [t for (l, t), n in seen.items() if l == lang and n >= min_docs]
        own = {s: {t: counts[lang, s][t] for t in terms} for l, s in groups if l == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in terms}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(terms)) for t in terms}
        p, q = {s: share(c) for s, c in own.items()}, share(whole)
        by = lambda x: (-x[1], x[0].encode())
        for s in own:
            pairs = sorted(((o, sum(abs(p[s][t] - p[o][t]) for t in terms)) for o in own if o != s), key=by)
            more = sorted(((t, p[s][t] - q[t]) for t in terms if own[s][t] and p[s][t] > q[t]), key=by)[:top]
            out.update((lang, s, part, item, value, rank) for part, found in (("pair", pairs), ("term", more)) for rank, (item, value) in enumerate(found, 1))
    return out


@pytest.mark.parametrize("block", [256, 1])
def test_divergence(spark, docs, block):
    """Blocks of one source each give the same as one block."""
    got = divergence.audit(docs, 12, 3, block=block)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = brute_audit(odd_docs(), 12, 3)
    assert Counter(map(tuple, got.collect())) == want
    assert {part for _, _, part, *_ in want} == {"pair", "term"} and ("yy", "one", "pair", "two", 0, 1) in want
    assert divergence.audit(docs.where("false")).count() == 0


def test_divergence_corrections_are_not_zero(docs):
    index = divergence.Index(docs, 12)
    assert index.corrections().where("source = item").count() == 0
    pairs = index.groups.alias("a").join(index.groups.alias("b"), F.expr("a.lang = b.lang AND a.source != b.source")).count()
    assert index.corrections().count() <= pairs


def test_divergence_counts_in_parts(docs):
    """A task that holds few counts sends them on more often."""
    total = lambda held: Counter({(r["lang"], r["source"], r["term"]): (r["n"], r["d"]) for r in divergence.term_counts(docs, held=held).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("d")).collect()})
    assert total(1) == total(10**6)


def brute_targets(sizes, most=3, budget=None):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    left, open_, fixed = sum(sizes.values()) if budget is None else budget, set(order), {}
    while open_:
        unit = Fraction(left, sum(weight[s] for s in open_))
        above = {s for s in open_ if unit * weight[s] > most * sizes[s]}
        if not above:
            return {s: unit * weight[s] for s in open_} | fixed
        fixed |= {s: Fraction(most * sizes[s]) for s in above}
        left, open_ = left - sum(most * sizes[s] for s in above), open_ - above
    return fixed


@pytest.mark.parametrize("budget", [None, 500, 10**7])
def test_mixing(spark, docs, budget):
    rows = odd_docs()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += count(text)
    goal = brute_targets(sizes, budget=budget)
    got = mixing.mix(docs, budget=budget)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken", "first_at"]
    found = got.collect()
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((i, count(t)) for i, t, *_ in rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] and (r["first_at"] is None) == (r["taken"] == 0) for r in found)
    pieces = mixing.queue(docs, budget=budget).collect()
    taken = Counter()
    for p in pieces:
        taken[p["source"]] += p["taken"]
        assert p["source_size"] == sizes[p["source"]] and abs(p["target"] - goal[p["source"]]) < 1e-6
    assert sum(taken.values()) == min(sum(sizes.values()) if budget is None else budget, 3 * sum(sizes.values()))
    assert all(abs(taken[s] - goal[s]) <= len(sizes) + 1 for s in sizes)
    order = sorted((p for p in pieces if p["words"]), key=lambda p: p["place"])
    assert [p["place"] for p in order] == [sum(p["words"] for p in order[:i]) for i in range(len(order))]
    assert all(a["finish"] <= b["finish"] for a, b in zip(order, order[1:]))
    again = mixing.mix(docs.repartition(2), budget=budget)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, found))
    assert mixing.mix(docs.where("false")).count() == 0


def test_mixing_documents_are_shuffled_and_repeated(spark):
    rows = [(i, "w " * 10, "en", s, *MORE) for i, s in enumerate(["a"] * 50 + ["b"] * 900 + ["c"] * 50)]
    found = {r["doc_id"]: r["taken"] for r in mixing.mix(spark.createDataFrame(rows, DOC)).collect()}
    assert [sum(found[i] for i in of) for of in (range(50), range(50, 950), range(950, 1000))] == [1500, 7000, 1500]
    assert {found[i] for i in range(50)} == {30} and {found[i] for i in range(50, 950)} == {0, 10}
    first = [i for i in range(50, 950) if found[i]]
    assert 0.35 < sum(i < 500 for i in first) / len(first) < 0.65


def test_running_sums(spark):
    rows = [(i % 7, i, i % 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b long, n long").repartition(8)
    got = {r["b"]: r["before"] for r in common.running(df, [F.col("a"), F.col("b")], "n", "before").collect()}
    total = 0
    for _, b, n in sorted(rows):
        assert got[b] == total
        total += n


def test_automaton_on_repetitive_text():
    """One word, or two, many times: windows as brute force has them, in time in proportion."""
    import time

    from cambium.llm import decontaminate

    rng = random.Random(9)
    for _ in range(60):
        items = [(str(i), rng.choices([b"a", b"b"], [4, 1], k=rng.randrange(1, 30))) for i in range(4)]
        text = rng.choices([b"a", b"b", b"c"], [6, 2, 1], k=60)
        automaton = decontaminate.SuffixAutomaton(items, 5)
        spans, found, _ = automaton.spans(text)
        hit, names = set(), set()
        for name, words in items:
            k = min(5, len(words))
            for w in {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}:
                for i in range(len(text) - k + 1):
                    if tuple(text[i : i + k]) == w:
                        hit |= set(range(i, i + k))
                        names.add(name)
        assert {p for a, b in spans for p in range(a, b)} == hit and found == names
    began = time.process_time()
    automaton = decontaminate.SuffixAutomaton([("x", [b"n"] * 64_000)])
    spans, _, longest = automaton.spans([b"n"] * 64_000)
    assert spans == [[0, 64_000]] and longest == 64_000 and time.process_time() - began < 5


def test_an_item_larger_than_a_block(spark):
    from cambium.llm import decontaminate

    rng = random.Random(4)
    words = [f"w{rng.randrange(500)}" for _ in range(400)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "a b c")], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(["x", *words[i : i + 40], "y"])) for i in range(0, 360, 7)] + [(999, "a b c d")], "doc_id long, text string")
    plain = lambda df: sorted((r["doc_id"], r["n_words"], str(r["spans"]), str(r["items"])) for r in df.collect())
    assert plain(decontaminate.find_contamination(docs, bench, block_bytes=300)) == plain(decontaminate.find_contamination(docs, bench))
