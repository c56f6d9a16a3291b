"""Changes of a graph as functions from frames to frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.functions import names
from edgeloom.plans.frames import DETAILS, IMPORTS, MODULES, Frames


def add(frames: Frames, modules=(), imports=(), details=()) -> Frames:
    """Rows added to each relation; modules already there keep their flag."""
    spark = frames.modules.sparkSession

    def plus(df: DataFrame, rows, schema: str) -> DataFrame:
        return df.unionByName(spark.createDataFrame(list(rows), schema)).distinct() if rows else df

    new = spark.createDataFrame(list(modules), MODULES) if modules else None
    grown = frames.modules if new is None else frames.modules.unionByName(new.join(frames.modules, "name", "left_anti"))
    return Frames(grown, plus(frames.imports, imports, IMPORTS), plus(frames.details, details, DETAILS))


def _apart(df: DataFrame, gone) -> DataFrame:
    return df.where(~gone(F.col("importer")) & ~gone(F.col("imported")))


def remove_module(frames: Frames, module: str) -> Frames:
    """Without the module, all below it, and their imports."""
    gone = lambda c: names.within(c, module)
    return Frames(frames.modules.where(~gone(F.col("name"))), _apart(frames.imports, gone), _apart(frames.details, gone))


def remove_import(frames: Frames, importer: str, imported: str) -> Frames:
    keep = ~((F.col("importer") == importer) & (F.col("imported") == imported))
    return Frames(frames.modules, frames.imports.where(keep), frames.details.where(keep))


def squash_module(frames: Frames, module: str) -> Frames:
    """The module stands for all below it: their outer edges become its own, without details; inner ones go.

    An edge between the module and one below it becomes a loop at the module.
    """
    below = lambda c: names.below(c, module)
    a, b = F.col("importer"), F.col("imported")
    own = lambda c: F.when(below(c), F.lit(module)).otherwise(c)
    imports = frames.imports.where(~(below(a) & below(b))).select(own(a).alias("importer"), own(b).alias("imported")).distinct()
    modules = frames.modules.where(~below(F.col("name"))).withColumn("is_squashed", F.col("is_squashed") | (F.col("name") == module))
    return Frames(modules, imports, _apart(frames.details, below))
