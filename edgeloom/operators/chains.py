"""Shortest chains of imports, for many pairs of module sets at once."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators import kernels
from edgeloom.operators.reach import KERNEL_EDGES, fits, levels, shipped, union
from edgeloom.storage import materialize

SCHEMA = "group long, chain array<string>"
_ARROW = pa.schema([("group", pa.int64()), ("chain", pa.list_(pa.string()))])


def _sets(table: pa.Table) -> tuple[set, set, set]:
    sets = {"head": set(), "tail": set(), "barred": set()}
    for role, name in zip(table.column("role").to_pylist(), table.column("name").to_pylist()):
        sets[role].add(name)
    return sets["head"], sets["tail"], sets["barred"]


def _rows(group: int, chains) -> pa.Table:
    chains = [list(c) for c in chains]
    return pa.table({"group": pa.array([group] * len(chains), pa.int64()), "chain": pa.array(chains, pa.list_(pa.string()))}, schema=_ARROW)


def _search(search: kernels.Search, every: bool):
    if every:
        return search.all_shortest()
    one = search.shortest()
    return [one] if one else []


def find_chains(imports: DataFrame, roles: DataFrame, every: bool = True, strategy: str = "auto", kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """(group, chain) for each group of ``roles`` (group, role, name), roles being head, tail and barred.

    ``every``: all chains of the greedy search, each without the edges of those
    before; else one.  Equal lengths: the smallest by name.  A group's search is
    sequential, groups run side by side.  Graphs too large to ship are cut, by
    rounds over all groups, to the edges between each group's ends, and only
    those reach its search.
    """
    roles = roles.select(F.col("group").cast("long").alias("group"), "role", "name")
    imports = materialize(imports.select("importer", "imported"), "imports")  # read once a round otherwise
    if strategy == "kernel" or strategy == "auto" and fits(imports, kernel_edges):
        graph = shipped(imports)

        def run(key, table):
            return _rows(key[0].as_py(), _search(kernels.Search(*graph(), *_sets(table)), every))

        return roles.groupBy("group").applyInArrow(run, SCHEMA)
    roles = materialize(roles, "roles")
    if not every:
        return _one_by_rounds(imports, roles)
    edges = materialize(edges_between(imports, roles), "between")

    def paired(key, table, found):
        heads, tails, _ = _sets(table)
        search = kernels.Greedy.of_columns(found.column("importer"), found.column("imported"), heads, tails)
        del found
        return _rows(key[0].as_py(), search.chains())

    roles = roles.where("role <> 'barred'")  # none of them is left in the edges
    return roles.groupBy("group").cogroup(edges.groupBy("group")).applyInArrow(paired, SCHEMA)


def _of(roles: DataFrame, role: str) -> DataFrame:
    return roles.where(F.col("role") == role).select("group", "name").distinct()


def _one_by_rounds(imports: DataFrame, roles: DataFrame) -> DataFrame:
    """A chain a group: levels back from the tails until one meets a head, then the smallest name of each level on the way down.

    The driver holds the chains themselves, a name a group and step.
    """
    back = levels(imports, _of(roles, "tail"), False, _of(roles, "barred"), _of(roles, "head"))
    chains: dict[int, list[str]] = {}
    for n in range(len(back) - 1, -1, -1):
        here = back[n]
        heads = here.where("met").groupBy("group").agg(F.min("name").alias("name"))
        if chains:
            ends = imports.sparkSession.createDataFrame([(g, c[-1]) for g, c in chains.items()], "group long, importer string")
            edges = imports.where(F.col("importer").isin([c[-1] for c in chains.values()]))
            next_ = ends.hint("merge").join(edges, "importer").select("group", F.col("imported").alias("name"))
            next_ = next_.hint("merge").join(here, ["group", "name"], "left_semi").groupBy("group").agg(F.min("name").alias("name"))
            # a group's levels end where they meet its heads
            heads = heads.where(~F.col("group").isin(list(chains))).unionAll(next_)
        for group, name in heads.collect():
            chains.setdefault(group, []).append(name)
    return imports.sparkSession.createDataFrame(list(chains.items()), SCHEMA)


def edges_between(imports: DataFrame, roles: DataFrame) -> DataFrame:
    """(group, importer, imported): the edges that can lie on a chain of the group, and few others where the group reaches few modules.

    Rounds that reach a large part of the graph cut little and are broken off; what
    they would have cut is left to the search, which never comes to it.
    """
    heads, tails, barred = (_of(roles, role) for role in ("head", "tail", "barred"))
    groups = [r.group for r in roles.select("group").distinct().collect()]
    edges = imports.select(F.explode(F.array(*map(F.lit, groups)).cast("array<long>")).alias("group"), "importer", "imported")
    most = max(1, imports.count() // 8) * len(groups)
    # a shortest chain meets heads and tails at its ends only
    for end, starts, others in (("importer", heads, tails), ("imported", tails, heads)):
        closed = barred.unionAll(others).distinct()
        reached = levels(imports, starts, end == "importer", closed, most=most)
        side = closed if reached is None else union([x.select("group", "name") for x in reached])
        edges = edges.join(side.withColumnRenamed("name", end).hint("merge"), ["group", end], "left_anti" if reached is None else "left_semi")
    return edges.select("group", "importer", "imported")
