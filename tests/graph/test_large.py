"""What large graphs must not do: pass through the driver, or be searched once a chain."""

import random
import time

from edgeloom.operators import chains, kernels, reach


def plans_since(spark, first=0):
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [p for p in (runs.apply(i) for i in range(runs.size())) if p.executionId() >= first]


def random_edges(seed, count=60):
    r = random.Random(seed)
    nodes = [f"{p}.{i}" for p in "abcde" for i in range(6)]
    return nodes, sorted({(x, y) for x, y in ((r.choice(nodes), r.choice(nodes)) for _ in range(count)) if x != y})


def no_broadcast(spark, run):
    first = max((p.executionId() for p in plans_since(spark)), default=-1) + 1
    rows = run().collect()
    plans = [p.physicalPlanDescription() for p in plans_since(spark, first)]
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)
    return rows


def test_reach_by_rounds_sends_no_table_through_the_driver(spark):
    nodes, edges = random_edges(1)
    imports = spark.createDataFrame(edges, "importer string, imported string")
    starts = spark.createDataFrame([(0, n) for n in nodes if n[0] == "a"], "group long, name string")
    assert no_broadcast(spark, lambda: reach.find_reach(imports, starts, strategy="rounds"))


def test_graph_of_tables_sends_no_table_through_the_driver(spark, sf_dir):
    from edgeloom import testgraph

    plan = testgraph.frames(spark, sf_dir).imports
    plan.collect()
    assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()


def test_one_chain_by_rounds(spark):
    for seed in (3, 4):
        nodes, edges = random_edges(seed, 40)
        imports = spark.createDataFrame(edges, "importer string, imported string")
        sides = [(g, role, n) for g, ends in enumerate(["ab", "be", "ca"]) for role, p in zip(("head", "tail"), ends) for n in nodes if n[0] == p]
        roles = spark.createDataFrame(sides + [(3, "head", "a.0"), (3, "tail", "none")], "group long, role string, name string")
        one = no_broadcast(spark, lambda: chains.find_chains(imports, roles, False, "rounds"))
        out, into = kernels.adjacency(edges)
        ends = {g: [{n for i, role, n in sides if i == g and role == side} for side in ("head", "tail")] for g in range(3)}
        assert {r.group: tuple(r.chain) for r in one} == {g: c for g, e in ends.items() if (c := kernels.Search(out, into, *e).shortest())}


def test_rounds_end_where_they_meet_what_is_sought(spark):
    imports = spark.createDataFrame([(f"m{i}", f"m{i + 1}") for i in range(9)], "importer string, imported string")
    starts, sought = (spark.createDataFrame(rows, "group long, name string") for rows in ([(0, "m0"), (1, "m0")], [(0, "m2"), (1, "m4")]))
    found = {(r.group, r.name) for r in reach.find_reach(imports, starts, strategy="rounds", stop_at=sought).collect()}
    assert found == {(0, "m1"), (0, "m2"), *((1, f"m{i}") for i in range(1, 5))}


def test_chains_of_one_length_share_a_search():
    ways = [tuple(f"{p}.{i:04}" for p in "abcd") for i in range(3000)]
    out, into = kernels.adjacency(e for w in ways for e in zip(w, w[1:]))
    started = time.process_time()
    found = kernels.Search(out, into, {w[0] for w in ways}, {w[-1] for w in ways}).all_shortest()
    assert found == ways and time.process_time() - started < 3


def test_search_by_rounds_of_few_and_of_many_modules(spark):
    far = [(f"z.{i}", f"z.{i + 1}") for i in range(90)]
    for near in ([("a.1", "b.1"), ("a.1", "c.1"), ("c.1", "b.1"), ("a.2", "c.1"), ("c.1", "b.2")], random_edges(5)[1]):
        imports = spark.createDataFrame([*near, *(far if len(near) < 9 else [])], "importer string, imported string")
        sides = [(g, role, f"{p}.{i}") for g, ends in enumerate(["abe", "acb"]) for role, p in zip(("head", "tail", "barred"), ends) for i in range(6)]
        roles = spark.createDataFrame(sides, "group long, role string, name string")
        many = chains.edges_between(imports, roles).where("importer like 'z.%'").count()
        assert many == 0
        found = [{(r.group, tuple(r.chain)) for r in chains.find_chains(imports, roles, True, s).collect()} for s in ("kernel", "rounds")]
        assert found[0] == found[1] and found[0]
