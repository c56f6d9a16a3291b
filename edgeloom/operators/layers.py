"""Layered architectures: which pairs may not import each other, and by what routes they do."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.model import Layer
from edgeloom.operators import hierarchy
from edgeloom.operators.chains import find_chains
from edgeloom.plans.frames import Frames
from edgeloom.storage import materialize

LEVELS = "container string, level int, module string, independent boolean, closed boolean"


def level_rows(spark: SparkSession, layers: Iterable[Layer], containers: Iterable[str] = ()) -> DataFrame:
    """A row for each module that a layer names in a container, and one without a module for each level.

    The latter keeps levels that hold no module: a closed one is a barrier still.
    """
    rows = []
    for container in sorted(containers) or [None]:
        for i, layer in enumerate(layers):
            rows.append((container, i, None, layer.independent, layer.closed))
            rows += [(container, i, f"{container}.{t}" if container else t, layer.independent, layer.closed) for t in sorted(layer.module_tails)]
    return spark.createDataFrame(rows, LEVELS)


def permutations(levels: DataFrame) -> DataFrame:
    """(container, importer, imported) that are illegal: lower to higher, between independent siblings, and past a closed level.

    ``levels`` is what a user wrote down, so its self-join is small.
    """
    named = levels.where("module is not null")
    barriers = levels.where("closed").groupBy("container").agg(F.collect_set("level").alias("closed_levels"))
    a = named.select("container", F.col("module").alias("importer"), F.col("level").alias("from"), "independent")
    b = named.select(F.col("container").alias("_container"), F.col("module").alias("imported"), F.col("level").alias("to"))
    met = a.join(b, F.col("container").eqNullSafe(F.col("_container")) & (F.col("importer") != F.col("imported"))).drop("_container")
    barriers = barriers.withColumnRenamed("container", "_container")
    met = met.join(barriers, F.col("container").eqNullSafe(F.col("_container")), "left")
    past = F.exists(F.coalesce("closed_levels", F.array().cast("array<int>")), lambda c: (c > F.col("from")) & (c < F.col("to")))
    illegal = (F.col("from") > F.col("to")) | ((F.col("from") == F.col("to")) & F.col("independent")) | ((F.col("from") < F.col("to")) & past)
    return met.where(illegal).select("container", "importer", "imported").distinct()


def present(levels: DataFrame, modules: DataFrame) -> DataFrame:
    """Levels without the modules that the graph lacks."""
    known = modules.select(F.col("name").alias("module"))
    return levels.where("module is null").unionAll(levels.where("module is not null").join(known.hint("merge"), "module", "left_semi").select(*levels.columns))


def pair_roles(frames: Frames, levels: DataFrame, pairs: DataFrame) -> DataFrame:
    """(group, role, name) of each pair (group, container, importer, imported): its two packages, and all other layers' modules barred."""
    layers = levels.where("module is not null").select("container", F.col("module").alias("package")).distinct()
    sides = pairs.select("group", F.lit("head").alias("role"), F.col("importer").alias("package")).unionAll(pairs.select("group", F.lit("tail"), F.col("imported")))
    inside = hierarchy.members(frames.modules, sides).select("group", "role", F.col("module").alias("name"))
    others = layers.withColumnRenamed("container", "_container").join(pairs, F.col("_container").eqNullSafe(F.col("container"))).select("group", "package")
    barred = hierarchy.members(frames.modules, others).select("group", F.col("module").alias("name")).distinct().join(inside.hint("merge"), ["group", "name"], "left_anti")
    return inside.unionAll(barred.select("group", F.lit("barred").alias("role"), "name"))


def routes_of(frames: Frames, pairs: DataFrame, roles: DataFrame, chains: DataFrame) -> DataFrame:
    """(importer, imported, heads, middle, tails): chains by their middles, with all heads and tails that the whole graph gives them.

    Sides that grow with the graph are merged, here and above: a broadcast would pass through the driver.
    """
    size = F.size("chain")
    direct = chains.where(size == 2).select("group", F.array(F.element_at("chain", 1)).alias("heads"), F.array().cast("array<string>").alias("middle"), F.array(F.element_at("chain", -1)).alias("tails"))
    middles = chains.where(size > 2).select("group", F.expr("slice(chain, 2, size(chain) - 2)").alias("middle")).distinct()
    ends = middles.select("group", "middle", F.element_at("middle", 1).alias("start"), F.element_at("middle", -1).alias("end"))
    heads = roles.where("role = 'head'").select("group", F.col("name").alias("importer"))
    tails = roles.where("role = 'tail'").select("group", F.col("name").alias("imported"))
    into = ends.hint("merge").join(frames.imports, F.col("start") == F.col("imported")).select("group", "middle", "importer").join(heads.hint("merge"), ["group", "importer"], "left_semi")
    out = ends.hint("merge").join(frames.imports, F.col("end") == F.col("importer")).select("group", "middle", "imported").join(tails.hint("merge"), ["group", "imported"], "left_semi")
    into = into.groupBy("group", "middle").agg(F.array_sort(F.collect_set("importer")).alias("heads"))
    out = out.groupBy("group", "middle").agg(F.array_sort(F.collect_set("imported")).alias("tails"))
    indirect = into.join(out.hint("merge"), ["group", "middle"]).select("group", "heads", "middle", "tails")
    return direct.unionAll(indirect).distinct().join(pairs.select("group", "importer", "imported"), "group").select("importer", "imported", "heads", "middle", "tails")


def numbered(pairs: DataFrame) -> DataFrame:
    """Pairs with a number each; equal pairs of different containers stay apart."""
    return pairs.withColumn("group", F.xxhash64("container", "importer", "imported"))


def illegal_routes(frames: Frames, levels: DataFrame, strategy: str = "auto") -> DataFrame:
    """(importer, imported, heads, middle, tails) of every illegal dependency."""
    known = present(levels, frames.modules)
    # each is read more than once below, and the searches must run once
    pairs = materialize(numbered(permutations(known)), "pairs")
    roles = materialize(pair_roles(frames, known, pairs), "roles")
    chains = materialize(find_chains(frames.imports, roles, strategy=strategy), "chains")
    return routes_of(frames, pairs, roles, chains)
