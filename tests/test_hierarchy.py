"""Hierarchies against plain walks."""

import random
from collections import defaultdict

import pytest

from anamnesis.operators.hierarchy import link_hierarchy


def brute(nodes, links):
    ids = {n for n in nodes if n is not None}
    ls = {(p, c) for p, c in links if p in ids and c in ids}
    down, up = defaultdict(set), defaultdict(set)
    for p, c in ls:
        down[p].add(c)
        up[c].add(p)

    def reach(n):
        seen, todo = set(), list(down[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += down[x]
        return seen

    below = {n: reach(n) for n in ids}
    circ = {n for n in ids if n in below[n]}
    bad = circ | {x for n in circ for x in below[n]}
    out = [(n, "", -1, "", -1) for n in bad]

    def walk(n, root, path):
        out.append((n, root, len(path) - 1, "/".join(path), len(below[n])))
        for c in down[n]:
            if c not in bad:
                walk(c, root, [*path, c])

    for n in ids:
        if not up[n] and n not in bad:
            walk(n, n, [n])
    return sorted(out)


def run(spark, nodes, links):
    n = spark.createDataFrame([(x, 1) for x in nodes], "summary_id string, depth int")
    e = spark.createDataFrame([(*x, "clash") for x in links], "summary_id string, parent_summary_id string, depth string")
    return sorted(tuple(r) for r in link_hierarchy(n, e, "summary_id", "summary_id", "parent_summary_id").collect())


def test_trees_diamonds_and_circles(spark):
    nodes = ["r", "a", "b", "d", "e", "x", "y", "z", "t", "s", "lone", None, "r"]
    links = [("r", "a"), ("r", "b"), ("a", "d"), ("b", "d"), ("d", "e"), ("r", "a"), ("x", "y"), ("y", "x"), ("y", "z"), ("b", "x"), ("s", "s"), ("t", "gone"), (None, "a"), ("s", "e")]
    assert run(spark, nodes, links) == brute(nodes, links)


def test_empty(spark):
    assert run(spark, [], []) == []


def test_long_chain_and_wide_star(spark):
    nodes = [f"c{i:03}" for i in range(70)] + [f"s{i}" for i in range(60)]
    links = [(f"c{i:03}", f"c{i + 1:03}") for i in range(69)] + [("c005", f"s{i}") for i in range(60)]
    assert run(spark, nodes, links) == brute(nodes, links)


@pytest.mark.parametrize("seed", [3, 4])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(30)]
    links = [(f"n{i}", f"n{j}") for _ in range(28) for i, j in [sorted(rng.sample(range(30), 2))]] + [("n29", f"n{rng.randrange(20, 29)}")]
    assert run(spark, nodes, links) == brute(nodes, links)
