"""Communities of weighted graphs by modularity: local moves, refinement, and the same over the refined parts until nothing changes.

Each level has two phases. First nodes move, one after another, to the
neighbouring community of largest gain, until no move gains. Communities are
then refined: starting from single nodes, those that are well connected to their
community join well connected parts of it, a part drawn in proportion to its
gain. The parts become the nodes of the next level, whose communities are those
already found, so a community that a later move would leave in pieces comes
apart.

A graph of at most BLOCK links goes through its levels in one task, several
graphs in as many. Levels of larger ones are Spark jobs, until so few links
between parts are left. There a round looks at all nodes, and those that would gain
are dealt to tasks of about BLOCK links each, in which they move while all others
stay. Where that is one task, each move gains what it seems to; moves of
several tasks at once are held against the modularity before, and if they don't
raise it, those of one task stay. So every round raises the modularity, and the
rounds end when no node would gain.

Several graphs, or one graph at several resolutions, go through the same jobs;
`graph` numbers them. Only one row a graph comes to the driver. Draws are hashes
of nodes, so results depend neither on partitions nor on their order.
"""

from __future__ import annotations

import math
import random
from collections import defaultdict, deque
from collections.abc import Sequence
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import kept

#: Gains below this are none.
LEAST = 1e-9
#: Links, about, that a task works on at once.
BLOCK = 200_000
#: Where a task has room for more than the nodes that would gain, those that lose least by a move are looked at too: losses, of a link's mean weight.
NEXT = tuple(2.0**i for i in range(-20, 5))


def both_ways(edges: DataFrame, *keys: str) -> DataFrame:
    """(a, b, weight) of an undirected graph with each pair both ways, once, and loops once; repeated pairs add up."""
    pairs = edges.groupBy(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("weight"))
    return pairs.unionByName(pairs.where("a <> b").select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def chance(*columns):
    """A number from 0 to 1, exclusive, by hash."""
    return (F.pmod(F.xxhash64(*columns), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def chosen_by(values: dict[int, float], column: str = "graph"):
    """The value of each row's graph."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col(column)) if values else F.lit(None).cast("double")


def move(near: dict[int, list], community: dict[int, int], degree: dict[int, float], whole: dict[int, float], pull: float) -> list[int]:
    """Nodes of `near` (links of each: node, weight) that have moved, one after another, each to the community of largest gain, until none gains; `community` and `whole` (a community's degree) are changed. Nodes that only `community` has stay where they are."""
    start = {n: community[n] for n in near}
    queue: deque = deque()
    waiting, told, moved = set(), set(near), True
    # Number of the last move that a node has seen, and of the last by which a community rose or fell.
    turn, looked, rose, fell = 0, dict.fromkeys(near, 0), dict.fromkeys(whole, 0), dict.fromkeys(whole, 0)
    while queue or moved:
        if not queue:
            # All nodes are looked at once more, for the communities' weights have changed.
            queue, waiting, moved = deque(near), set(near), False
        node = queue.popleft()
        waiting.discard(node)
        own, links, last = community[node], near[node], looked[node]
        if node in told:
            told.discard(node)
        elif rose[own] <= last:
            for b, _ in links:
                if fell[community[b]] > last:
                    break
            else:
                continue  # nothing that it would gain by has changed
        looked[node], k = turn, degree[node]
        inside = defaultdict(float)
        for b, weight in links:
            inside[community[b]] += weight
        cost = pull * k
        stay = inside.pop(own, 0.0) - cost * (whole[own] - k)
        best, to = stay + LEAST, None
        for c, weight in inside.items():
            score = weight - cost * whole[c]
            if score > stay and ((score := round(score, 9)) > best or (score == best and to is not None and c < to)):
                best, to = score, c
        if to is None or best - stay <= LEAST:
            continue
        whole[own] -= k
        whole[to] += k
        turn += 1
        looked[node] = fell[own] = rose[to] = turn
        community[node], moved = to, True
        for b, _ in links:
            if b in looked and community[b] != to:
                told.add(b)
                if b not in waiting:
                    waiting.add(b)
                    queue.append(b)
    return [n for n in near if community[n] != start[n]]


def joined_parts(near: dict[int, list], degree: dict[int, float], whole: dict[int, float], pull: float, salt: int) -> dict[int, int]:
    """The part of each node of whole communities: single nodes that are well connected join well connected parts, one after another, until none can. `near` has the links inside communities, `whole` the degree of each node's community."""
    part, total, size = {n: n for n in near}, {n: degree[n] for n in near}, dict.fromkeys(near, 1)
    cut = {n: sum(w for _, w in near[n]) for n in near}
    well = lambda p: cut[p] >= pull * total[p] * (whole[p] - total[p])
    joined = True
    while joined:
        joined = False
        for node, links in near.items():
            if part[node] != node or size[node] > 1 or not well(node):
                continue
            inside = defaultdict(float)
            for b, weight in links:
                inside[part[b]] += weight
            draw = random.Random(node * 1_000_003 + salt)
            found = [(math.log(gain) - math.log(-math.log(draw.uniform(1e-300, 1))), p) for p, weight in sorted(inside.items()) if (gain := weight - pull * degree[node] * total[p]) > LEAST and well(p)]
            if found:
                to = max(found)[1]
                part[node], joined = to, True
                cut[to] += cut[node] - 2 * inside[to]
                total[to] += degree[node]
                size[to] += 1
                size[node] = 0
    return part


def placed_links(rows: pd.DataFrame) -> tuple[dict, dict, dict, dict]:
    """Links, community and degree of each node and the degree of each community, of rows a, b, weight, k, own, whole (of a) and other, other_whole (of b)."""
    community, degree, whole, near = {}, {}, {}, defaultdict(list)
    for a, b, weight, k, own, own_whole, other, other_whole in rows.sort_values(["a", "b"])[["a", "b", "weight", "k", "own", "whole", "other", "other_whole"]].itertuples(index=False, name=None):
        community[a], community[b], degree[a], whole[own], whole[other] = own, other, k, own_whole, other_whole
        near[a].append((b, weight))
    return near, community, degree, whole


def moves_of_block(rows: pd.DataFrame) -> pd.DataFrame:
    """graph, id and community of a block's nodes that move until none gains; nodes of other blocks stay where they are.

    Rows are links of the block's nodes: graph, a, b, weight, k, own, whole (of a) and other, other_whole (of b), and pull.
    """
    near, community, degree, whole = placed_links(rows)
    gone = move(near, community, degree, whole, rows["pull"].iat[0])
    return pd.DataFrame({"graph": rows["graph"].iat[0], "id": gone, "community": [community[n] for n in gone]})


def moves_of_numbered_block(rows: pd.DataFrame) -> pd.DataFrame:
    return moves_of_block(rows).assign(block=rows["block"].iat[0])


def parts_of_communities(rows: pd.DataFrame) -> pd.DataFrame:
    """graph, id and part of the nodes of whole communities, joined until none can.

    Rows are the links inside communities: graph, a, b, weight, k and whole (of a), pull and salt.
    """
    degree, whole, near = {}, {}, defaultdict(list)
    for a, b, weight, k, of_all in rows.sort_values(["a", "b"])[["a", "b", "weight", "k", "whole"]].itertuples(index=False, name=None):
        degree[a], whole[a] = k, of_all
        near[a].append((b, weight))
    part = joined_parts(near, degree, whole, rows["pull"].iat[0], int(rows["salt"].iat[0]))
    return pd.DataFrame({"graph": rows["graph"].iat[0], "id": list(part), "part": list(part.values())})


def levels_of_graph(rows: pd.DataFrame) -> pd.DataFrame:
    """graph, id and community of a graph's linked nodes after all levels that are left; communities hang together and have the name of a node.

    Rows are all links between nodes, as for moves_of_block, and level, the number of the first one.
    """
    pull, level = rows["pull"].iat[0], int(rows["level"].iat[0])
    near, community, degree, whole = placed_links(rows)
    node_of = {n: n for n in near}
    while True:
        gone = move(near, community, degree, whole, pull)
        inner = {n: own for n, links in near.items() if (own := [(b, w) for b, w in links if community[b] == community[n]])}
        part = {n: n for n in near} | joined_parts(inner, degree, {n: whole[community[n]] for n in inner}, pull, 2 * level + 1)
        if not gone and len(set(part.values())) == len(near):
            break
        sums, weights = defaultdict(float), defaultdict(lambda: defaultdict(float))
        for n, links in near.items():
            sums[part[n]] += degree[n]
            for b, weight in links:
                if part[b] != part[n]:
                    weights[part[n]][part[b]] += weight
        community = {part[n]: community[n] for n in near}
        near = {p: sorted(weights[p].items()) for p in sorted(sums)}
        degree, node_of, level = sums, {n: part[p] for n, p in node_of.items()}, level + 1
    name: dict[int, int] = {}
    for first in near:
        todo = [] if first in name else [first]
        name.setdefault(first, first)
        while todo:
            node = todo.pop()
            for b, _ in near[node]:
                if b not in name and community[b] == community[node]:
                    name[b] = first
                    todo.append(b)
    return pd.DataFrame({"graph": rows["graph"].iat[0], "id": list(node_of), "community": [name[p] for p in node_of.values()]})


class Graphs:
    """links (graph, a, b, weight; both ways), nodes (graph, id, k, links) and what each graph's moves are weighed by."""

    def __init__(self, links: DataFrame, resolutions: dict[int, float]):
        weight = F.when(F.col("a") == F.col("b"), 2 * F.col("weight")).otherwise(F.col("weight"))  # a loop counts twice in its node's degree
        self.nodes = kept(links.groupBy("graph", F.col("a").alias("id")).agg(F.sum(weight).alias("k"), F.sum(F.when(F.col("a") == F.col("b"), 2 * F.col("weight")).otherwise(0.0)).alias("looped"), F.count_if(F.col("a") != F.col("b")).alias("links")))
        sums = self.nodes.groupBy("graph").agg(F.sum("k").alias("twice"), F.sum("looped").alias("looped"), F.count(F.lit(1)).alias("n"), F.sum("links").alias("links")).collect()  # one row a graph
        self.twice = {r["graph"]: r["twice"] for r in sums if r["twice"] > 0}
        self.looped, self.size, self.count = ({r["graph"]: r[c] for r in sums} for c in ("looped", "n", "links"))
        self.resolutions = resolutions
        #: Graphs that one task each takes.
        self.few = {g for g, n in self.count.items() if n <= BLOCK}
        self.links = links.where("a <> b")
        self.blocks = {g: max(1, -(-n // BLOCK)) for g, n in self.count.items()}

    def pull(self):
        """What a unit of degree times a unit of degree costs."""
        return chosen_by({g: self.resolutions[g] / t for g, t in self.twice.items()})

    def keep(self, graphs: Sequence[int]) -> None:
        """From here on these graphs only."""
        self.links = self.links.where(F.col("graph").isin(list(graphs)))
        self.twice = {g: t for g, t in self.twice.items() if g in set(graphs)}

    def met(self, asked: DataFrame, placed: DataFrame) -> DataFrame:
        """Links of the nodes `asked` (graph, id, ...) with what moves_of_block needs: the columns of `asked`, and community and whole of both ends by `placed` (graph, id, k, own, whole)."""
        more = [c for c in asked.columns if c not in ("graph", "id")]
        of = placed.select("graph", F.col("id").alias("b"), F.col("own").alias("other"), F.col("whole").alias("other_whole"))
        return self.links.join(asked.select("graph", F.col("id").alias("a"), *more), ["graph", "a"]).join(of, ["graph", "b"]).withColumn("pull", self.pull())

    def with_whole(self, state: DataFrame) -> DataFrame:
        """graph, id, k, own and whole, the degree of the own community."""
        whole = state.groupBy("graph", "community").agg(F.sum("k").alias("whole"))
        return state.join(whole, ["graph", "community"]).select("graph", "id", "k", F.col("community").alias("own"), "whole")

    def solved(self, state: DataFrame, level: int) -> DataFrame:
        """(graph, id, community) of the graphs in `few`, after all levels that are left, each graph in a task."""
        state = state.where(F.col("graph").isin(sorted(self.few)))
        placed = self.with_whole(state.where(F.col("graph").isin(sorted(self.twice))))
        found = self.met(placed, placed).withColumn("level", F.lit(level)).groupBy("graph").applyInPandas(levels_of_graph, "graph int, id long, community long")
        # Nodes without links are by themselves.
        return state.select("graph", "id").join(found, ["graph", "id"], "left").select("graph", "id", F.coalesce("community", "id").alias("community"))

    def judged(self, state: DataFrame) -> DataFrame:
        """Of each node: k, links, the own community with its whole degree, inside, the weight to it, and the best other community with its gain (null: none)."""
        near = self.links.join(state.select("graph", F.col("id").alias("b"), "community"), ["graph", "b"]).select("graph", F.col("a").alias("id"), "community", "weight", F.lit(False).alias("mine"), F.lit(1).alias("links"))
        itself = state.select("graph", "id", "community", F.lit(0.0).alias("weight"), F.lit(True).alias("mine"), F.lit(0).alias("links"))
        near = near.unionByName(itself).groupBy("graph", "id", "community").agg(F.sum("weight").alias("inside"), F.max("mine").alias("mine"), F.sum("links").alias("links"))
        whole = state.groupBy("graph", "community").agg(F.sum("k").alias("whole"))
        scored = near.join(whole, ["graph", "community"]).join(state.select("graph", "id", "k"), ["graph", "id"])
        score = F.col("inside") - self.pull() * F.col("k") * (F.col("whole") - F.when(F.col("mine"), F.col("k")).otherwise(0.0))
        own = lambda c: F.max(F.when(F.col("mine"), F.col(c)))
        best = scored.withColumn("score", score).groupBy("graph", "id", "k").agg(
            F.sum("links").alias("links"), own("community").alias("own"), own("whole").alias("whole"), own("inside").alias("inside"), own("score").alias("stay"),
            F.max(F.when(~F.col("mine"), F.struct(F.round("score", 9).alias("score"), (-F.col("community")).alias("name")))).alias("best"),
        )
        return best.select("graph", "id", "k", "links", "own", "whole", "inside", (-F.col("best.name")).alias("to"), (F.col("best.score") - F.col("stay")).alias("gain"))

    def unit(self) -> dict[int, float]:
        """The mean weight of a link."""
        return {g: t / max(1, self.count[g]) for g, t in self.twice.items()}

    def weighed(self, table: DataFrame) -> dict[int, dict]:
        """Of each graph of `judged`: modularity, and how many links those nodes have that gain more than nothing and than each of NEXT below it."""
        above = lambda x: F.sum(F.when(F.col("gain") > x, F.col("links")).otherwise(0))
        unit = chosen_by(self.unit())
        sums = table.groupBy("graph").agg(F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("whole")).alias("squares"), above(F.lit(LEAST)).alias("wanting"), *[above(-x * unit).alias(f"next_{i}") for i, x in enumerate(NEXT)])
        rows = {r["graph"]: r.asDict() for r in sums.collect()}  # one row a graph
        return {g: r | {"modularity": (r["inside"] + self.looped[g]) / t - self.resolutions[g] * r["squares"] / t**2} for g, r in rows.items() if (t := self.twice.get(g))}

    def in_blocks(self, table: DataFrame, seen: dict[int, dict], graphs: set[int], salt: int, number: int) -> DataFrame:
        """graph, id, k, was, community and block (null: not moved), after the moves of those nodes of these graphs that would gain."""
        blocks = {g: -(-seen[g]["wanting"] // BLOCK) for g in graphs}
        unit, least = self.unit(), {}
        for g in graphs:
            wide = [i for i in range(len(NEXT)) if seen[g][f"next_{i}"] <= BLOCK]
            least[g] = -NEXT[wide[-1]] * unit[g] if blocks[g] == 1 and wide else LEAST
        asked = table.where(F.col("graph").isin(sorted(graphs))).where(F.col("gain") > chosen_by(least)).withColumn("key", F.least("own", "to"))
        # Nodes that would join each other meet in a block, if not too many have the same key.
        if max(blocks.values()) > 1:
            often = asked.groupBy("graph", "key").agg(F.ceil(F.sum("links") / BLOCK).alias("parts")).where("parts > 1")
            asked = asked.join(F.broadcast(often), ["graph", "key"], "left")  # a few rows a block
            part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("parts")))
        else:
            part = F.lit(0)
        block = F.pmod(F.xxhash64("key", part.cast("long"), F.lit(salt), F.lit(number)), chosen_by(blocks)).cast("int")
        near = self.met(asked.select("graph", "id", "k", "own", "whole", block.alias("block")), table)
        went = near.groupBy("graph", "block").applyInPandas(moves_of_numbered_block, "graph int, id long, community long, block int")
        return table.select("graph", "id", "k", F.col("own").alias("was")).join(went, ["graph", "id"], "left").select("graph", "id", "k", "was", F.coalesce("community", "was").alias("community"), "block")

    def moved(self, state: DataFrame, salt: int) -> tuple[DataFrame, set[int]]:
        """The state (graph, id, k, community) after local moves, and the graphs in which any node has moved."""
        table = kept(self.judged(state))
        seen, changed, left = self.weighed(table), set(), set(self.twice)
        for number in count():
            left = {g for g in left if seen[g]["wanting"]}
            if not left:
                return state, changed
            tried = kept(self.in_blocks(table, seen, left, salt, number))
            went = {r["graph"]: r["block"] for r in tried.where("block IS NOT NULL").groupBy("graph").agg(F.min("block").alias("block")).collect()}  # one row a graph
            left &= set(went)
            changed |= left
            if not left:
                return state, changed
            after = kept(self.judged(tried))
            found = self.weighed(after)
            worse = {g: went[g] for g in left if seen[g]["wanting"] > BLOCK and found[g]["modularity"] <= seen[g]["modularity"] + LEAST}
            if worse:
                back = F.col("graph").isin(sorted(worse)) & (F.col("block") != chosen_by(worse))
                tried = tried.withColumn("community", F.when(back, F.col("was")).otherwise(F.col("community")))
                after = kept(self.judged(tried))
                found = self.weighed(after)
            state, table, seen = tried.select("graph", "id", "k", "community"), after, found

    def refined(self, state: DataFrame, salt: int) -> DataFrame:
        """(graph, id, part): parts of the communities, each connected, named by a node of theirs."""
        named = self.links.join(state.select("graph", F.col("id").alias("a"), "community"), ["graph", "a"]).join(state.select("graph", F.col("id").alias("b"), F.col("community").alias("other")), ["graph", "b"])
        inner = named.where("community = other").select("graph", "a", "b", "community", "weight")
        whole = state.groupBy("graph", "community").agg(F.sum("k").alias("whole"))
        pull = self.pull()
        # Communities with few links inside are refined in blocks; larger ones, if there are any, join in rounds.
        large = kept(inner.groupBy("graph", "community").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK))
        many = not large.isEmpty()
        counted = inner.join(state.select("graph", F.col("id").alias("a"), "k"), ["graph", "a"]).join(whole, ["graph", "community"])
        if many:
            counted = counted.join(large, ["graph", "community"], "left_anti")
            inner = kept(inner.join(large, ["graph", "community"], "left_semi"))
        dealt = counted.withColumns({"pull": pull, "salt": F.lit(salt), "block": F.pmod(F.xxhash64("community"), chosen_by(self.blocks))})
        begun = dealt.groupBy("graph", "block").applyInPandas(parts_of_communities, "graph int, id long, part long")
        parts = kept(state.join(whole, ["graph", "community"]).join(begun, ["graph", "id"], "left").select("graph", "id", "k", "whole", F.coalesce("part", "id").alias("part")))
        for number in count():
            if not many:
                return parts.select("graph", "id", "part")
            of = parts.select("graph", F.col("id").alias("a"), F.col("part").alias("own")), parts.select("graph", F.col("id").alias("b"), "part")
            near = inner.join(of[0], ["graph", "a"]).join(of[1], ["graph", "b"]).where("own <> part").groupBy("graph", "own", "part").agg(F.sum("weight").alias("weight"))
            cut = near.groupBy("graph", F.col("own").alias("part")).agg(F.sum("weight").alias("cut"))
            sums = parts.groupBy("graph", "part").agg(F.sum("k").alias("k"), F.count(F.lit(1)).alias("n"), F.first("whole").alias("whole"))
            well = sums.join(cut, ["graph", "part"]).where(F.col("cut") >= pull * F.col("k") * (F.col("whole") - F.col("k")))
            single = well.where("n = 1").select("graph", F.col("part").alias("own"), F.col("k").alias("own_k"))
            met = near.join(single, ["graph", "own"]).join(well.select("graph", "part", "k", "n"), ["graph", "part"]).withColumn("gain", F.col("weight") - pull * F.col("own_k") * F.col("k"))
            met = kept(met.where(F.col("gain") > LEAST))
            if met.isEmpty():
                return parts.select("graph", "id", "part")
            # A single node goes or is gone to in a round, never both.
            goes = lambda name: chance(name, F.lit(salt), F.lit(number)) < 0.5  # noqa: B023, E731
            drawn = met.where(goes("own") & ((F.col("n") > 1) | ~goes("part"))).withColumn("draw", F.log("gain") - F.log(-F.log(chance("own", "part", F.lit(salt), F.lit(number)))))
            to = drawn.groupBy("graph", F.col("own").alias("id")).agg(F.max(F.struct("draw", F.col("part").alias("to")))["to"].alias("to"))
            parts = kept(parts.join(to, ["graph", "id"], "left").select("graph", "id", "k", "whole", F.coalesce("to", "part").alias("part")))


def connected_parts(links: DataFrame, state: DataFrame) -> DataFrame:
    """(graph, id, community): each community is split into its connected parts, named by their smallest node."""
    named = links.where("a <> b").join(state.select("graph", F.col("id").alias("a"), F.col("community").alias("own")), ["graph", "a"]).join(state.select("graph", F.col("id").alias("b"), "community"), ["graph", "b"])
    inner = kept(named.where("own = community").select("graph", "a", "b"))
    labels = state.select("graph", "id", F.col("id").alias("label"))
    while True:
        seen = inner.join(labels.withColumnRenamed("id", "b"), ["graph", "b"]).groupBy("graph", F.col("a").alias("id")).agg(F.min("label").alias("near"))
        after = kept(labels.withColumnRenamed("label", "was").join(seen, ["graph", "id"], "left").select("graph", "id", F.least("was", "near").alias("label"), "was"))
        # A label's own label: long chains shorten by doubling.
        jumped = kept(after.join(after.select("graph", F.col("id").alias("label"), F.col("label").alias("far")), ["graph", "label"]).select("graph", "id", F.least("label", "far").alias("label"), "was"))
        labels = jumped.select("graph", "id", "label")
        if jumped.where("label <> was").isEmpty():
            return labels.withColumnRenamed("label", "community")


def graph_communities(edges: DataFrame, resolutions: dict[int, float]) -> DataFrame:
    """graph, id and community of every node of (graph, a, b, weight), each graph at its resolution."""
    links = kept(both_ways(edges.where(F.col("graph").isin(sorted(resolutions))).select("graph", *[F.col(c).cast("long").alias(c) for c in "ab"], F.col("weight").cast("double").alias("weight")), "graph"))
    graphs = Graphs(links, resolutions)
    members = graphs.nodes.select("graph", "id", F.col("id").alias("node"))
    state, done = graphs.nodes.select("graph", "id", "k", F.col("id").alias("community")), []
    for level in count():
        ends = []
        if graphs.few or not graphs.size:
            ends.append(kept(graphs.solved(state, level)))
        going = sorted(set(graphs.size) - graphs.few)
        if going:
            left = F.col("graph").isin(going)
            graphs.keep(going)
            state, changed = graphs.moved(state.where(left), 2 * level)
            parts = kept(graphs.refined(state, 2 * level + 1))
            sizes = {r["graph"]: r["n"] for r in parts.select("graph", "part").distinct().groupBy("graph").agg(F.count(F.lit(1)).alias("n")).collect()}
            still = sorted(g for g, n in sizes.items() if g not in changed and n == graphs.size[g])
            if still:
                last = F.col("graph").isin(still)
                ends.append(connected_parts(graphs.links.where(last), state.where(last)))
                going = sorted(set(going) - set(still))
        for found in ends:
            done.append(members.join(found.select("graph", F.col("id").alias("node"), "community"), ["graph", "node"]).select("graph", "id", "community"))
        if not going:
            break
        left = F.col("graph").isin(going)
        members = kept(members.where(left).join(parts.select("graph", F.col("id").alias("node"), "part"), ["graph", "node"]).select("graph", "id", F.col("part").alias("node")))
        name = lambda side: parts.select("graph", F.col("id").alias(side), F.col("part").alias(f"p_{side}"))  # noqa: B023, E731
        one_way = links.where(left & (F.col("a") <= F.col("b"))).join(name("a"), ["graph", "a"]).join(name("b"), ["graph", "b"])
        links = kept(both_ways(one_way.select("graph", F.col("p_a").alias("a"), F.col("p_b").alias("b"), "weight"), "graph"))
        state = kept(parts.where(left).join(state, ["graph", "id"]).groupBy("graph", F.col("part").alias("id")).agg(F.sum("k").alias("k"), F.first("community").alias("community")))
        graphs = Graphs(links, resolutions)
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    named = found.groupBy("graph", "community").agg(F.min("id").alias("name"))
    return found.join(named, ["graph", "community"]).select("graph", "id", F.col("name").alias("community"))


def communities_at(edges: DataFrame, resolutions: Sequence[float], key: str | None = None) -> DataFrame:
    """resolution, id and community, and `key` if there is one (a column that tells graphs apart, a few hundred at most): all of them in the same jobs."""
    spark: SparkSession = edges.sparkSession
    keys = [None] if key is None else sorted(r[0] for r in edges.select(key).distinct().collect())
    table = [(i * len(resolutions) + j, k, float(r)) for i, k in enumerate(keys) for j, r in enumerate(resolutions)]
    kind = "string" if key is None else edges.schema[key].dataType.simpleString()
    numbers = spark.createDataFrame(table, f"graph int, __key {kind}, resolution double")
    named = edges.withColumn("__own", F.lit(None).cast("string") if key is None else F.col(key))
    numbered = named.join(F.broadcast(numbers), F.col("__own").eqNullSafe(F.col("__key"))).select("graph", "a", "b", "weight")  # one row a graph
    found = graph_communities(numbered, {g: r for g, _, r in table}).join(F.broadcast(numbers), "graph")
    return found.select(*([F.col("__key").alias(key)] if key else []), "resolution", "id", "community")


def communities(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """id and community of every node of (a, b, weight).

    Every community is connected and named by its smallest node. Nodes are longs; repeated pairs add up, loops count
    for their node; a graph without weight leaves every node by itself; an
    empty graph gives no rows.
    """
    return communities_at(edges, [resolution]).select("id", "community")


def modularity(edges: DataFrame, members: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row with the modularity of (id, community) over (a, b, weight)."""
    links = both_ways(edges)
    weight = F.when(F.col("a") == F.col("b"), 2 * F.col("weight")).otherwise(F.col("weight"))
    placed = links.join(members.toDF("a", "own"), "a").join(members.toDF("b", "other"), "b").withColumn("w", weight)
    by = placed.groupBy("own").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("own") == F.col("other"), F.col("w")).otherwise(0.0)).alias("inside"))
    sums = by.agg(F.sum("k").alias("twice"), F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("k")).alias("squares"))
    return sums.select((F.col("inside") / F.col("twice") - resolution * F.col("squares") / (F.col("twice") * F.col("twice"))).alias("modularity"))
