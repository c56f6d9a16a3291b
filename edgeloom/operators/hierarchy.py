"""Filters and hierarchy over ``modules``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.functions import expressions, names


def children(modules: DataFrame, module: str) -> DataFrame:
    """Modules exactly one level below.  The prefix test reaches the scan, the depth test what is left."""
    name = F.col("name")
    return modules.where(names.below(name, module) & (names.depth(name) == module.count(".") + 2)).select("name")


def descendants(modules: DataFrame, module: str) -> DataFrame:
    return modules.where(names.below(F.col("name"), module)).select("name")


def matching(modules: DataFrame, expression: str) -> DataFrame:
    return modules.where(expressions.matches(F.col("name"), expression)).select("name")


def members(modules: DataFrame, packages: DataFrame) -> DataFrame:
    """Every module of each row's ``package``, itself included: ``packages`` with ``module`` added.

    Names are exploded into their ancestors, which makes the prefix test a hash join.
    """
    keyed = modules.select(F.col("name").alias("module"), F.explode(names.self_and_ancestors(F.col("name"))).alias("package"))
    return packages.join(keyed, "package")
