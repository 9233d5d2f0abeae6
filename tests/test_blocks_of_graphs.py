"""Moves and refinement in blocks against what they have to leave: nothing to gain, and parts that hang together."""

import numpy as np
import pandas as pd

from cambium.operators import communities


def planted(groups=6, size=20):
    draw = np.random.default_rng(2)
    n = groups * size
    return {(i, j): float(draw.integers(1, 4)) for i in range(n) for j in range(i + 1, n) if draw.random() < (0.5 if i % groups == j % groups else 0.03)}


def rows_of(links, state, nodes, resolution=1.0):
    both = [(a, b, w) for (a, b), w in links.items()] + [(b, a, w) for (a, b), w in links.items()]
    k, whole = dict.fromkeys(state, 0.0), dict.fromkeys(state.values(), 0.0)
    for a, _, w in both:
        k[a] += w
    for n, c in state.items():
        whole[c] += k[n]
    pull = resolution / sum(k.values())
    found = [(0, a, b, w, k[a], state[a], whole[state[a]], state[b], whole[state[b]], pull, 5) for a, b, w in both if a in nodes]
    return pd.DataFrame(found, columns=["graph", "a", "b", "weight", "k", "own", "whole", "other", "other_whole", "pull", "salt"]), k, pull


def test_moves_leave_nothing_to_gain():
    """A block of all nodes finds what was planted and stops where no move gains; a block of some leaves the others alone."""
    links = planted()
    state = {n: n for n in range(120)}
    rows, k, pull = rows_of(links, state, set(state))
    went = communities.moves_of_block(rows.sample(frac=1, random_state=3))
    after = state | dict(zip(went["id"], went["community"]))
    again, _, _ = rows_of(links, after, set(state))
    assert communities.moves_of_block(again).empty
    assert len(set(after.values())) == 6 and all(len({after[n] for n in range(120) if n % 6 == g}) == 1 for g in range(6))
    some = set(range(0, 120, 2))
    part = communities.moves_of_block(rows[rows["a"].isin(some)])
    assert set(part["id"]) <= some and len(part) and set(part["community"]) <= set(state)


def test_parts_hang_together_and_stay_inside():
    links = planted()
    state = {n: n % 3 for n in range(120)}  # two planted groups each
    rows, _, _ = rows_of(links, state, set(state))
    inner = rows[rows["own"] == rows["other"]]
    found = communities.parts_of_communities(inner)
    part = dict(zip(found["id"], found["part"]))
    assert len(set(part.values())) < 60 and all(state[n] == state[p] for n, p in part.items())
    near = inner.groupby("a")["b"].apply(set)
    for p in set(part.values()):
        own = {n for n in part if part[n] == p}
        seen, todo = {p}, [p]
        while todo:
            new = (near[todo.pop()] & own) - seen
            seen |= new
            todo += new
        assert seen == own
    assert communities.parts_of_communities(inner.sample(frac=1, random_state=1)).sort_values("id").reset_index(drop=True).equals(found.sort_values("id").reset_index(drop=True))


def connected(links, found):
    """Whether each community hangs together."""
    near = {}
    for a, b in links:
        if found[a] == found[b]:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for c in set(found.values()):
        own = {n for n in found if found[n] == c}
        seen, todo = set(), [min(own)]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += near.get(n, ())
        if seen != own:
            return False
    return True


def test_all_levels_in_one_task():
    links = planted()
    rows, _, _ = rows_of(links, {n: n for n in range(120)}, set(range(120)))
    rows["level"] = 0
    found = communities.levels_of_graph(rows)
    named = dict(zip(found["id"], found["community"]))
    assert set(named) == set(range(120)) and connected(links, named)
    assert len(set(named.values())) == 6 and all(len({named[n] for n in range(120) if n % 6 == g}) == 1 for g in range(6))
    assert communities.levels_of_graph(rows.sample(frac=1, random_state=4)).equals(found)


def jobs_of(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_few_jobs(spark, monkeypatch):
    """A graph of one block takes a few jobs whatever its levels; one of several blocks finds as much, and the other graph beside it the same."""
    links = planted()
    rows = [("x", a, b, w) for (a, b), w in links.items()] + [("y", a, b, 1.0) for a, b in ((0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5), (7, 7))]
    edges = spark.createDataFrame(rows, "name string, a long, b long, weight double")
    work = lambda: {(r["name"], r["id"]): r["community"] for r in communities.communities_at(edges, [1.0], "name").collect()}
    found, jobs = jobs_of(spark, "one block", work)
    assert jobs <= 40
    monkeypatch.setattr(communities, "BLOCK", 400)  # of about 1,500 links
    again, jobs = jobs_of(spark, "several blocks", work)
    assert jobs <= 400 and set(again) == set(found)
    for one in (found, again):
        assert {n: c for (g, n), c in one.items() if g == "y"} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 7: 7}
        named = {n: c for (g, n), c in one.items() if g == "x"}
        assert connected(links, named) and all(c == min(n for n in named if named[n] == c) for c in named.values())
        assert len(set(named.values())) == 6 and all(len({named[n] for n in range(120) if n % 6 == g}) == 1 for g in range(6))
