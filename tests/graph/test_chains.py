"""Reach and chains: hand-built shapes, and random graphs against plain searches."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from edgeloom import ImportGraph
from edgeloom.errors import ModuleNotPresent
from edgeloom.operators import chains, kernels, reach
from tests.graph.test_queries_small import build


@pytest.fixture(scope="module")
def graph(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "x"), ("x", "y"), ("y", "c"), ("c", "a"), ("c", "d.one"), ("d.two", "e"), ("p.one", "a")]
    return build(spark, ["d", "p", "lonely", "p.two"], edges)


def test_reach(graph):
    assert graph.find_upstream_modules("b") == {"c", "a", "x", "y", "d.one"}
    assert graph.find_upstream_modules("d") == set()
    assert graph.find_upstream_modules("d", as_package=True) == {"e"}
    assert graph.find_downstream_modules("d", as_package=True) == {"c", "a", "b", "x", "y", "p.one"}
    assert graph.find_upstream_modules("p", as_package=True) == {"a", "b", "c", "x", "y", "d.one"}
    with pytest.raises(ModuleNotPresent):
        graph.find_upstream_modules("gone")


def test_chain(graph):
    assert graph.find_shortest_chain("a", "c") == ("a", "b", "c")
    assert graph.find_shortest_chain("p", "d", as_packages=True) == ("p.one", "a", "b", "c", "d.one")
    assert graph.find_shortest_chain("a", "lonely") is None
    assert graph.chain_exists("a", "d", as_packages=True) and not graph.chain_exists("a", "d")
    for call in (graph.find_shortest_chain, graph.find_shortest_chains, graph.chain_exists):
        with pytest.raises(ValueError):
            call("a", "a")
    with pytest.raises(ValueError, match="not present"):
        graph.find_shortest_chain("gone", "a")
    with pytest.raises(ModuleNotPresent):
        graph.find_shortest_chains("gone", "a")


def test_chains_without_common_edges(graph):
    assert graph.find_shortest_chains("a", "c", as_packages=False) == {("a", "b", "c"), ("a", "x", "y", "c")}
    assert graph.find_shortest_chains("lonely", "c") == set()


def test_sparse_packages(spark):
    g = build(spark, [f"{p}.{i}" for p in "abc" for i in range(100)] + ["a", "b", "c"], [e for i in range(0, 100, 10) for e in ((f"a.{i}", f"b.{i}"), (f"b.{i}", f"c.{i}"))])
    assert len(g.find_shortest_chains("a", "c")) == 10


def plain_reach(edges, starts):
    seen, todo = set(starts), deque(starts)
    while todo:
        for b in sorted(b for a, b in edges if a == todo[0] and b not in seen):
            seen.add(b)
            todo.append(b)
        todo.popleft()
    return seen - set(starts)


@pytest.mark.parametrize("seed", range(40))
def test_kernel_against_plain_search(seed):
    r = random.Random(seed)
    nodes = [f"{p}.{i}" for p in "abcde" for i in range(4)]
    edges = {(x, y) for x, y in ((r.choice(nodes), r.choice(nodes)) for _ in range(45)) if x != y}
    heads, tails, barred = ({n for n in nodes if n[0] == p} for p in "abe")
    out, into = kernels.adjacency(edges)
    assert kernels.reach(out, heads) == plain_reach(edges, heads)
    found = kernels.Search(out, into, heads, tails, barred).all_shortest()
    # the same greedy search, done naively
    left, expected = {e for e in edges if e[1] not in barred}, []
    while True:
        best = None
        level = sorted((h,) for h in heads)
        seen = set(heads)
        while level and best is None:
            done = sorted(c for c in level if c[-1] in tails)
            best = done[0] if done else None
            level = sorted(c + (b,) for c in level for a, b in left if a == c[-1] and b not in seen)
            seen |= {c[-1] for c in level}
        if best is None:
            break
        expected.append(best)
        left -= set(zip(best, best[1:]))
    assert sorted(found) == sorted(expected)
    used = [e for c in found for e in zip(c, c[1:])]
    assert len(used) == len(set(used)) and set(used) <= edges


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_equal_kernel(spark, seed):
    r = random.Random(seed)
    nodes = [f"{p}.{i}" for p in "abcde" for i in range(6)]
    edges = sorted({(x, y) for x, y in ((r.choice(nodes), r.choice(nodes)) for _ in range(60)) if x != y})
    imports = spark.createDataFrame(edges, "importer string, imported string")
    starts = spark.createDataFrame([(i, n) for i, p in enumerate("ab") for n in nodes if n[0] == p], "group long, name string")
    for upstream in (True, False):
        both = [{(x.group, x.name) for x in reach.find_reach(imports, starts, upstream, s).collect()} for s in ("kernel", "rounds")]
        assert both[0] == both[1]
        assert {n for g, n in both[0] if g == 0} == plain_reach([e if upstream else e[::-1] for e in edges], {n for n in nodes if n[0] == "a"})
    roles = spark.createDataFrame([(g, role, n) for g, (h, t, b) in enumerate(["abe", "cda"]) for role, p in (("head", h), ("tail", t), ("barred", b)) for n in nodes if n[0] == p], "group long, role string, name string")
    both = [{(x.group, tuple(x.chain)) for x in chains.find_chains(imports, roles, True, s).collect()} for s in ("kernel", "rounds")]
    assert both[0] == both[1] and both[0]
    assert reach.fits(imports, 1) is False and reach.fits(imports)
    empty = ImportGraph(spark)
    assert empty.frames.imports.agg(F.count(F.lit(1))).first()[0] == 0
