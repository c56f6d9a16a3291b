"""Layers and cycle breakers."""

import random

import pytest

from edgeloom import Layer, PackageDependency, Route
from edgeloom.errors import ModuleNotPresent, NoSuchContainer
from edgeloom.operators import cycles
from tests.graph.test_queries_small import build

TREE = ["m", *[f"m.{p}" for p in ("high", "medium", "low")], *[f"m.{p}.{c}" for p in ("high", "medium", "low") for c in ("one", "two")]]
LEGAL = [("m.high.one", "m.medium.one"), ("m.medium.two", "m.low.one"), ("m.high.two", "m.low.two")]


def layered(spark, *edges, extra=()):
    return build(spark, [*TREE, *extra], [*LEGAL, *edges])


def illegal(graph, layers=("high", "medium", "low"), containers=("m",)):
    return graph.find_illegal_dependencies_for_layers(list(layers), set(containers))


def test_no_illegal(spark):
    assert illegal(layered(spark)) == set()


def test_direct_and_indirect(spark):
    g = layered(spark, ("m.low.one", "m.high.two"), ("m.low.one", "u.a"), ("m.low.two", "u.a"), ("u.a", "u.b"), ("u.b", "m.high.one"), ("u.b", "m.high.two"))
    assert illegal(g) == {PackageDependency.new("m.low", "m.high", [Route.single_chained("m.low.one", "m.high.two"), Route.new(["m.low.one", "m.low.two"], ["m.high.one", "m.high.two"], ["u.a", "u.b"])])}
    absolute = g.find_illegal_dependencies_for_layers(["m.high", "m.medium", "m.low"])
    assert absolute == illegal(g)


def test_chains_through_other_layers_do_not_count(spark):
    g = layered(spark, ("m.low.one", "m.medium.one"), ("m.medium.one", "m.high.one"))
    assert {(d.importer, d.imported) for d in illegal(g)} == {("m.low", "m.medium"), ("m.medium", "m.high")}


@pytest.mark.parametrize("layer, bad", [(Layer("medium", "low"), True), ({"medium", "low"}, True), (("medium", "low"), True), (Layer("medium", "low", independent=False), False)])
def test_siblings(spark, layer, bad):
    got = illegal(layered(spark), ["high", layer])
    assert {(d.importer, d.imported) for d in got} == ({("m.medium", "m.low")} if bad else set())


@pytest.mark.parametrize("layers, bad", [
    (["high", Layer("medium", closed=True), "low"], {("m.high", "m.low")}),
    (["high", Layer("absent", closed=True), "low"], {("m.high", "m.low")}),
    (["high", Layer("absent", closed=False), "low"], set()),
    ([Layer("high", closed=True), "medium", "low"], set()),
])
def test_closed(spark, layers, bad):
    assert {(d.importer, d.imported) for d in illegal(layered(spark), layers)} == bad


def test_containers(spark):
    g = build(spark, ["one", "two", *[f"{c}.{p}" for c in ("one", "two") for p in ("high", "low")]], [("one.low", "one.high"), ("two.low", "u"), ("u", "two.high"), ("one.low", "two.high")])
    assert {(d.importer, d.imported) for d in illegal(g, ["high", "low", "absent"], ["one", "two"])} == {("one.low", "one.high"), ("two.low", "two.high")}
    with pytest.raises(NoSuchContainer):
        illegal(g, ["high"], ["gone"])
    with pytest.raises(ValueError, match="shared"):
        g.find_illegal_dependencies_for_layers(["one", "one.high"])


def test_cycle_breakers(spark):
    ring = [(f"p.n{i}", f"p.n{(i + 1) % 6}") for i in range(6)]
    g = build(spark, ["p"], ring)
    assert g.nominate_cycle_breakers("p") == {("p.n5", "p.n0")}
    heavy = build(spark, ["p"], [("p.a.x", "p.b"), ("p.a.y", "p.b.z"), ("p.b", "p.a"), ("p.a", "p.a.x"), ("q", "p.a")])
    assert heavy.nominate_cycle_breakers("p") == {("p.b", "p.a")}
    hidden = build(spark, ["p"], [("p.a.x", "p.b.y"), ("p.b.y", "p.a.z"), ("p.a.w", "p.b.y")])  # p.a and p.b are no modules
    assert hidden.nominate_cycle_breakers("p") == {("p.b.y", "p.a.z")}
    assert hidden.nominate_cycle_breakers("p.a.x") == set()
    with pytest.raises(ModuleNotPresent):
        g.nominate_cycle_breakers("gone")


@pytest.mark.parametrize("seed", range(60))
def test_ordering_leaves_no_cycle(seed):
    r = random.Random(seed)
    nodes = [f"n{i}" for i in range(8)]
    weights = {(a, b): r.randint(1, 5) for a, b in ((r.choice(nodes), r.choice(nodes)) for _ in range(18)) if a != b}
    order = cycles.ordering(nodes, weights)
    assert sorted(order) == nodes
    place = {n: i for i, n in enumerate(order)}
    left = [p for p in weights if place[p[0]] < place[p[1]]]
    free, todo = set(nodes), True
    while todo:
        todo = [n for n in free if not any(b == n and a in free for a, b in left)]
        free -= set(todo)
    assert not free
