"""Licence notices and texts, by the Dice coefficient over word bigrams of normalised text; DataFrame functions only.

Units of a text (its lines, its sentences within lines and over lines, its
paragraphs and the whole) are compared with the templates whose number of
bigrams allows the least coefficient; everything happens within the row, so
nothing is shuffled. Which templates a unit's number of bigrams allows is
looked up in a list made once.

Before that, units without any of a few words are left out. A unit that is
similar enough to a template has at least `least / (2 - least)` of the
template's bigrams; the words are chosen so that more bigrams than may be
missing have one of them. So nothing similar enough is left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, read
from .licence_texts import NOTICES, TEXTS

LEAST = 0.8
#: Paragraphs and sentences of a licence's text that are templates too have at least so many words.
PIECE_WORDS = 12

Template = tuple[str, str]


def pieces_of(text: str) -> list[str]:
    """A text, and its longer paragraphs and sentences."""
    paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n", text)]
    sentences = [s for p in paragraphs for s in re.split(r"(?<=[.!?])\s+", p)]
    longer = [p for p in [*paragraphs, *sentences] if len(p.split()) >= PIECE_WORDS]
    return list(dict.fromkeys([" ".join(paragraphs), *longer]))


def all_templates() -> list[Template]:
    """Name and text of each template; what several licences share word by word tells none of them apart and is left out."""
    found = [*NOTICES.items(), *((name, piece) for name, text in TEXTS.items() for piece in pieces_of(text))]
    grams = [tuple(bigrams_of(text)) for _, text in found]
    names = {g: {n for (n, _), other in zip(found, grams, strict=True) if other == g} for g in set(grams)}
    first = {g: i for i, g in reversed(list(enumerate(grams)))}
    return [f for i, (f, g) in enumerate(zip(found, grams, strict=True)) if len(names[g]) == 1 and first[g] == i]


def bigrams_of(text: str) -> list[str]:
    words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def least_common(size: int, least: float) -> int:
    """Bigrams of a template of `size` that a unit similar enough has, at least."""
    return math.ceil(least * size / (2 - least) - 1e-9)


def telling_words(templates: Iterable[list[str]], least: float) -> list[str]:
    """Words of which every unit similar enough to one of the templates has one; long words that occur often in templates go first."""
    chosen: set[str] = set()
    for grams in sorted(templates, key=len):
        left = {g for g in grams if chosen.isdisjoint(g.split())}
        while len(grams) - len(left) <= len(grams) - least_common(len(grams), least):
            counts = Counter(w for g in left for w in set(g.split()))
            word = max(counts, key=lambda w: (counts[w] * len(w) ** 2, w))
            chosen.add(word)
            left = {g for g in left if word not in g.split()}
    return sorted(chosen)


def words_pattern(words: list[str]) -> str:
    """Finds any of the words, and never misses one; A-Z in either case."""
    by_first: dict[str, list[str]] = {}
    for word in words:
        by_first.setdefault(word[0], []).append(word[1:])
    return "(?i)(?:^|[^0-9a-z])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_first.items()) + ")(?![0-9a-z])"


def hashed(gram: str) -> int:
    """Spark's xxhash64 of the two words."""
    first, second = gram.split()
    found = xxhash.xxh64_intdigest(second.encode(), xxhash.xxh64_intdigest(first.encode(), 42))
    return found - (1 << 64) if found >> 63 else found


def normalised(text):
    """Lower-case words parted by one space, lines by a line end; a bar after the end of a sentence."""
    low = F.regexp_replace(F.translate(text, UPPER + "|", LOWER + " "), r"[.!?]([ \n])", "|$1")
    return F.regexp_replace(low, r"[^0-9a-z\n|\u0080-\x{10ffff}]+", " ")


UNITS = r"""array_distinct(filter(transform(
    concat(
      split(norm, '[|\n]'),
      split(translate(norm, '|', ' '), '\n'),
      flatten(transform(split(norm, '\n *\n'), p -> split(translate(p, '\n', ' '), '[|]'))),
      transform(split(norm, '\n *\n'), p -> translate(p, '|\n', '  ')),
      array(translate(norm, '|\n', '  '))),
    u -> trim(regexp_replace(u, ' +', ' '))), u -> u <> ''))"""


def scan_licenses(docs: DataFrame, templates: list[Template] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_matches, licenses (names, sorted, comma-joined; empty if none) and best_dice.

    Units are the different ones among: what stands between line ends and
    sentence ends, lines, sentences and whole paragraphs whatever their line
    ends, and the whole text. Of each unit, the templates of the largest
    coefficient match if it is at least `least`. Words are digits, letters (A-Z
    lower-cased) and characters outside ASCII. Null texts and texts without
    words match nothing; templates of fewer than two words never match.
    Repeated rows and ids keep one row each.
    """
    known = [(name, bigrams_of(text)) for name, text in (all_templates() if templates is None else templates)]
    known = [(name, grams) for name, grams in known if grams]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if not known:
        return rows.select("doc_id", F.lit(0).cast("long").alias("n_matches"), F.lit("").alias("licenses"), F.lit(0.0).alias("best_dice"))
    low, high = least / (2 - least), (2 - least) / least
    sizes = [len(grams) for _, grams in known]
    most = math.floor(max(sizes) * high + 1e-9)
    allowed = [[k for k, t in enumerate(sizes) if low * t <= size + 1e-9 and size <= high * t + 1e-9] for size in range(most + 1)]
    table = "array({})".format(", ".join("array({})".format(", ".join(f"{hashed(g)}L" if hashed(g) > -(1 << 63) else str(hashed(g)) for g in grams)) for _, grams in known))
    names = "array({})".format(", ".join("'{}'".format(name.replace("\\", "\\\\").replace("'", "\\'")) for name, _ in known))
    index = "array({})".format(", ".join("array({})".format(", ".join(map(str, some))) if some else "cast(array() AS array<int>)" for some in allowed))
    pattern = words_pattern(telling_words((grams for _, grams in known), least))
    found = (
        rows.select("doc_id", F.when(F.col("text").rlike(pattern), normalised(F.col("text"))).alias("norm"))
        .withColumn("units", F.filter(F.expr(f"CASE WHEN norm IS NOT NULL THEN {UNITS} END"), lambda u: u.rlike(pattern)))
        .withColumn("lists", F.expr(f"filter(transform(units, u -> split(u, ' ')), l -> size(l) > 1 AND size(l) - 1 >= {low * min(sizes) - 1e-9})"))
        .withColumn("sets", F.expr("transform(lists, l -> array_distinct(transform(sequence(1, size(l) - 1), i -> xxhash64(element_at(l, i), element_at(l, i + 1)))))"))
        .withColumn(
            "dices",
            F.expr(
                f"""transform(filter(sets, s -> size(s) <= {most}), s -> transform(
                  element_at({index}, size(s) + 1),
                  k -> named_struct('name', element_at({names}, k + 1),
                                    'dice', 2.0D * size(array_intersect(s, element_at({table}, k + 1))) / (size(s) + size(element_at({table}, k + 1))))))"""
            ),
        )
        .withColumn("matches", F.expr(f"flatten(transform(dices, d -> filter(d, m -> m.dice >= {least}D AND m.dice = array_max(d.dice))))"))
    )
    return found.select(
        "doc_id",
        F.coalesce(F.size("matches"), F.lit(0)).cast("long").alias("n_matches"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct("matches.name")), ","), F.lit("")).alias("licenses"),
        F.coalesce(F.round(F.array_max("matches.dice"), 6), F.lit(0.0)).alias("best_dice"),
    )


def op8_license_scan(spark, sf_dir):
    return scan_licenses(read(spark, sf_dir, "documents"))


def _sql() -> str:
    values = ", ".join("({}, '{}', [{}])".format(k, name, ", ".join(f"'{g}'" for g in bigrams_of(t))) for k, (name, t) in enumerate(all_templates()))
    return rf"""
WITH t(k, name, grams) AS (VALUES {values}
), d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_replace(regexp_replace(translate(coalesce(text, ''), '{UPPER}|', '{LOWER} '), '[.!?]([ \n])', '|\1', 'g'), '[^0-9a-z\n|\x{{80}}-\x{{10ffff}}]+', ' ', 'g') AS norm
  FROM documents
), p AS (SELECT rid, norm, regexp_split_to_array(norm, '\n *\n') AS paras FROM d
), u AS (
  SELECT DISTINCT rid, trim(regexp_replace(u, ' +', ' ', 'g')) AS unit
  FROM (SELECT rid, unnest(
    regexp_split_to_array(norm, '[|\n]')
    || string_split(translate(norm, '|', ' '), chr(10))
    || flatten(list_transform(paras, lambda x: string_split(translate(x, chr(10), ' '), '|')))
    || list_transform(paras, lambda x: translate(x, '|' || chr(10), '  '))
    || [translate(norm, '|' || chr(10), '  ')]) AS u FROM p)
), w AS (SELECT rid, unit, string_split(unit, ' ') AS w FROM u WHERE unit <> ''
), g AS (
  SELECT rid, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
  FROM w WHERE len(w) > 1 AND len(w) - 1 >= {LEAST / (2 - LEAST)} * (SELECT min(len(grams)) FROM t)
), m AS (
  SELECT rid, unit, name, 2.0::DOUBLE * len(list_intersect(g.g, t.grams)) / (len(g.g) + len(t.grams)) AS dice
  FROM g JOIN t ON len(g.g) >= {LEAST / (2 - LEAST) - 1e-9} * len(t.grams) AND len(g.g) <= {(2 - LEAST) / LEAST + 1e-9} * len(t.grams)
), b AS (SELECT *, max(dice) OVER (PARTITION BY rid, unit) AS most FROM m
), a AS (
  SELECT rid, count(*) AS n_matches, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, max(dice) AS best FROM b WHERE dice >= {LEAST} AND dice = most GROUP BY rid
)
SELECT doc_id, CAST(coalesce(n_matches, 0) AS BIGINT) AS n_matches, coalesce(licenses, '') AS licenses, round(CAST(coalesce(best, 0) AS DOUBLE), 6) AS best_dice
FROM d LEFT JOIN a USING (rid)
"""


SQL = _sql()
