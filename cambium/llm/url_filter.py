"""Allow and block lists of hosts and path prefixes, matched with a trie.

The trie goes over the labels of the host from the right, then over the
segments of the path; the deepest rule that fits decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_az, read

#: Verdict, host and path prefix.
Rule = tuple[str, str, str]

#: The rules of op4: allow com/, block example.com/en/, allow www.example.com/en/, block net/es/, block net/fr/.
RULES: list[Rule] = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: A trie of at most so many characters is broadcast; more rules are joined with the urls instead.
BROADCAST_CHARS = 16 << 20


@dataclass
class Node:
    children: dict[str, Node] = field(default_factory=dict)
    paths: Node | None = None
    #: What is left of a rule's path after its last slash, with the rule and its verdict.
    ends: list[tuple[str, str, str]] = field(default_factory=list)


class UrlTrie:
    def __init__(self, rules: Iterable[Rule]):
        self.root = Node()
        for verdict, host, path in rules:
            self.add(verdict, host, path)

    def add(self, verdict: str, host: str, path: str) -> None:
        node = self.root
        for label in reversed(host.split(".")):
            node = node.children.setdefault(label, Node())
        node.paths = node = node.paths or Node()
        *segments, rest = path.split("/")
        for segment in segments:
            node = node.children.setdefault(segment, Node())
        node.ends.append((rest, host + path, verdict))
        node.ends.sort(key=lambda end: len(end[0]))

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits, by labels of the host and then by the path, and its verdict."""
        best: tuple[str | None, str | None] = (None, None)
        node = self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.children.get(label)
            if node is None:
                break
            if node.paths is not None:
                best = self._along(node.paths, segments) or best
        return best

    @staticmethod
    def _along(node: Node, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for i, segment in enumerate(segments):
            for rest, rule, verdict in node.ends:
                if segment.startswith(rest):
                    best = (rule, verdict)
            if i == len(segments) - 1 or (node := node.children.get(segment)) is None:
                break
        return best


def url_parts(url):
    """Host (A-Z lower-cased) and path of a url; both empty without `://` or for null."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return (
        lower_az(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)),
        F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1),
    )


def judge_urls(
    pages: DataFrame, rules: list[Rule] | None = None, url_col: str = "url", default: str = "allow", broadcast_chars: int = BROADCAST_CHARS
) -> DataFrame:
    """`pages` with the columns host, path, rule and verdict added.

    A rule fits its host and all subdomains if the path starts with the rule's
    path; of those that fit, the one with most host labels and then the longest
    path wins, and of equal rules the last. Without a rule, `rule` is null and
    the verdict is `default`. Null and malformed urls have an empty host and
    path, so no rule fits. Existing columns of these four names are replaced;
    repeated rows keep one row each, and without rules every verdict is
    `default`.
    """
    rules = RULES if rules is None else rules
    host, path = url_parts(F.col(f"`{url_col}`"))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parts = pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"))
    if sum(len(h) + len(p) for _, h, p in rules) > broadcast_chars:
        return _joined(parts, rules, default)
    sent = parts.sparkSession.sparkContext.broadcast(rules)
    schema = T.StructType([*parts.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = UrlTrie(sent.value)
        for batch in batches:
            hosts, paths = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            found = [trie.match(h, p) for h, p in zip(hosts, paths, strict=True)]
            added = [pa.array([f[i] for f in found], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "rule", "verdict"])

    return parts.mapInArrow(match, schema).withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def _joined(parts: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """For rules beyond the broadcast bound: each distinct host and path asks for its own prefixes by an equi-join."""
    spark = parts.sparkSession
    table = spark.createDataFrame(
        [(h, p.rpartition("/")[0], p.rpartition("/")[2], h + p, v, h.count("."), len(p), i) for i, (v, h, p) in enumerate(rules)],
        "rule_host string, rule_dir string, rest string, rule string, verdict string, labels int, path_chars int, nr int",
    )
    suffixes = "transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]')) - i + 1), '.'))"
    folders = "transform(sequence(1, size(split(path, '/', -1))), i -> array_join(slice(split(path, '/', -1), 1, i - 1), '/'))"
    asked = (
        parts.select("host", "path").distinct().select("*", F.explode(F.expr(suffixes)).alias("rule_host"))
        .select("*", F.explode(F.expr(folders)).alias("rule_dir"))
    )
    best = Window.partitionBy("host", "path").orderBy(F.desc("labels"), F.desc("path_chars"), F.desc("nr"))
    found = (
        asked.join(table, ["rule_host", "rule_dir"])
        .where("startswith(path, substr(rule, length(rule_host) + 1))")
        .withColumn("place", F.row_number().over(best))
        .where("place = 1")
        .select("host", "path", "rule", "verdict")
    )
    return parts.join(found, ["host", "path"], "left").select(*[F.col(f"`{c}`") for c in parts.columns], "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op4_url_filter(spark, sf_dir):
    return judge_urls(read(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


SQL = """
WITH a AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM a
), r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/') THEN 'com/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  END AS rule FROM p
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
