"""Which imports to remove so that the children of a package form no cycle."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.functions import names
from edgeloom.plans.frames import Frames


def child_imports(imports: DataFrame, package: str) -> DataFrame:
    """Edges between different children of a package: ``imports`` plus from_child and to_child."""
    a, b = F.col("importer"), F.col("imported")
    inside = imports.where(names.below(a, package) & names.below(b, package))
    mapped = inside.withColumns({"from_child": names.child_of(a, package), "to_child": names.child_of(b, package)})
    return mapped.where("from_child <> to_child")


def edge_weights(imports: DataFrame, package: str) -> DataFrame:
    """(from_child, to_child, weight): the number of edges between two children as packages."""
    return child_imports(imports, package).groupBy("from_child", "to_child").agg(F.count(F.lit(1)).alias("weight"))


def child_names(modules: DataFrame, package: str) -> DataFrame:
    """All children, those too that are no module but hold some."""
    return modules.where(names.below(F.col("name"), package)).select(names.child_of(F.col("name"), package).alias("name")).distinct()


def ordering(nodes: Iterable[str], weights: dict[tuple[str, str], int]) -> list[str]:
    """An order of few backward edges: sources first, sinks last, the rest by weight out less weight in, then by name."""
    out: dict[str, dict[str, int]] = {n: {} for n in nodes}
    into: dict[str, dict[str, int]] = {n: {} for n in out}
    for (a, b), w in weights.items():
        out[a][b] = into[b][a] = w

    def drop(n: str) -> None:
        for b in out.pop(n):
            del into[b][n]
        for a in into.pop(n):
            del out[a][n]

    def peel(side: dict) -> Iterable[list[str]]:
        while ready := sorted(n for n, others in side.items() if not others):
            for n in ready:
                drop(n)
            yield ready

    sources = [n for batch in peel(into) for n in batch]
    sinks = [n for batch in reversed(list(peel(out))) for n in batch]
    middle = []
    while out:
        best = min(out, key=lambda n: (sum(into[n].values()) - sum(out[n].values()), n))
        middle.append(best)
        drop(best)
    return sources + middle + sinks


def cycle_breakers(frames: Frames, package: str) -> DataFrame:
    """(importer, imported) whose removal leaves the package's children without a cycle.

    The driver orders the children of one package; edges are counted and picked
    where they are.
    """
    spark = frames.imports.sparkSession
    children = [r.name for r in child_names(frames.modules, package).collect()]
    if len(children) < 2:
        return frames.imports.limit(0)
    weights = {(r.from_child, r.to_child): r.weight for r in edge_weights(frames.imports, package).collect()}
    place = {n: i for i, n in enumerate(ordering(children, weights))}
    backward = [p for p in weights if place[p[1]] < place[p[0]]]
    if not backward:
        return frames.imports.limit(0)
    picked = spark.createDataFrame(backward, "from_child string, to_child string")
    return child_imports(frames.imports, package).join(picked, ["from_child", "to_child"], "left_semi").select("importer", "imported")
