"""What lies behind a set of modules, for many sets at once.

Graphs of at most ``KERNEL_EDGES`` edges are sent to the executors, which search
them for each group; larger ones advance all groups together, a level a round,
each round written to the shared folder.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators import kernels
from edgeloom.storage import materialize

#: A graph of this many edges takes about 100 MB in a worker.
KERNEL_EDGES = 500_000

_GRAPHS: dict[int, tuple] = {}


def fits(imports: DataFrame, most: int = KERNEL_EDGES) -> bool:
    return imports.limit(most + 1).count() <= most


def shipped(imports: DataFrame):
    """A function that gives a worker both adjacency maps of a graph whose size has been checked."""
    spark = imports.sparkSession
    shared = spark.sparkContext.broadcast(imports.select("importer", "imported").toArrow())
    key = shared._jbroadcast.id()

    def graph() -> tuple[kernels.Edges, kernels.Edges]:
        if key not in _GRAPHS:
            _GRAPHS.clear()
            table = shared.value
            _GRAPHS[key] = kernels.adjacency(zip(table.column(0).to_pylist(), table.column(1).to_pylist()))
        return _GRAPHS[key]

    return graph


def find_reach(imports: DataFrame, starts: DataFrame, upstream: bool = True, strategy: str = "auto", kernel_edges: int = KERNEL_EDGES, stop_at: DataFrame | None = None) -> DataFrame:
    """(group, name) behind each group's ``starts`` (group, name), without the starts.

    ``upstream`` follows imports, else their reverse.  With ``stop_at`` (group,
    name), a group goes no further than the first level that meets it.
    """
    imports = materialize(imports.select("importer", "imported"), "imports")  # read once a round otherwise
    if strategy == "kernel" or strategy == "auto" and fits(imports, kernel_edges):
        return _by_kernel(imports, starts, upstream)
    return _by_rounds(imports, starts, upstream, stop_at=stop_at)


def _by_kernel(imports: DataFrame, starts: DataFrame, upstream: bool) -> DataFrame:
    graph = shipped(imports)

    def run(key, table):
        found = sorted(kernels.reach(graph()[0 if upstream else 1], table.column("name").to_pylist()))
        return pa.table({"group": pa.array([key[0].as_py()] * len(found), pa.int64()), "name": pa.array(found, pa.string())})

    return starts.select(F.col("group").cast("long").alias("group"), "name").groupBy("group").applyInArrow(run, "group long, name string")


def _by_rounds(imports: DataFrame, starts: DataFrame, upstream: bool, barred: DataFrame | None = None, stop_at: DataFrame | None = None) -> DataFrame:
    found = levels(imports, starts, upstream, barred, stop_at)
    return union([x.select("group", "name") for x in found[1:] or [found[0].limit(0)]])


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def levels(imports: DataFrame, starts: DataFrame, upstream: bool, barred: DataFrame | None = None, stop_at: DataFrame | None = None, most: int | None = None) -> list[DataFrame] | None:
    """(group, name, met) of each level of the rounds, the starts first; ``met`` tells names of ``stop_at``, whose group ends there.

    None once there are more than ``most`` rows, for callers that need no exact answer then.
    Nothing but a row a group reaches the driver: the edges lie partitioned and
    sorted, and what is new in a level is found by one aggregation, so no join
    is left that could be a broadcast.
    """
    a, b = ("importer", "imported") if upstream else ("imported", "importer")
    parts = int(imports.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = imports.select(F.col(a).alias("name"), F.col(b).alias("next")).repartition(parts, "name").sortWithinPartitions("name").persist(StorageLevel.DISK_ONLY)
    mark = lambda df, **flags: df.select(F.col("group").cast("long").alias("group"), "name", *(F.lit(flags.get(f, False)).alias(f) for f in ("new", "old", "met")))
    marked = ([mark(barred, old=True)] if barred is not None else []) + ([mark(stop_at, met=True)] if stop_at is not None else [])

    def level_of(rows: list[DataFrame]) -> DataFrame:
        flags = union(rows).groupBy("group", "name").agg(*(F.max(f).alias(f) for f in ("new", "old", "met")))
        return materialize(flags.where("new and not old").select("group", "name", "met"), "level")

    try:
        level = level_of([mark(starts, new=True), *marked[1 if barred is not None else 0 :]])
        found, seen, rows = [level], [level], 0
        while True:
            state = level.groupBy("group").agg(F.max("met"), F.count(F.lit(1))).collect()
            rows += sum(n for _, _, n in state)
            if most is not None and rows > most:
                return None
            going = [g for g, met, _ in state if not met]
            if not going:
                break
            if len(going) < len(state):
                level = level.where(F.col("group").isin(going))
            ahead = level.join(edges.hint("merge"), "name").select("group", F.col("next").alias("name"))
            level = level_of([mark(ahead, new=True), *(mark(x, old=True) for x in seen), *marked])
            found.append(level)
            seen.append(level)
            if len(seen) > 8:  # keep the number of tables of a round bounded
                seen = [materialize(union(seen), "seen")]
    finally:
        edges.unpersist()
    return found[:-1] if len(found) > 1 and not state else found
