"""Queries of single edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.functions import expressions, names


def between(imports: DataFrame, importer: str, imported: str, as_packages: bool = False) -> DataFrame:
    """Edges from one module to another, or from one package to another."""
    a, b = F.col("importer"), F.col("imported")
    if as_packages:
        return imports.where(names.within(a, importer) & names.within(b, imported))
    return imports.where((a == importer) & (b == imported))


def imported_by(imports: DataFrame, module: str) -> DataFrame:
    return imports.where(F.col("importer") == module).select(F.col("imported").alias("name"))


def importers_of(imports: DataFrame, module: str) -> DataFrame:
    return imports.where(F.col("imported") == module).select(F.col("importer").alias("name"))


def details_of(details: DataFrame, importer: str, imported: str) -> DataFrame:
    return between(details, importer, imported).distinct().orderBy("line_number", "line_contents")


def matching(imports: DataFrame, expression: str) -> DataFrame:
    importer, imported = expressions.compile_import_expression(expression)
    return imports.where(F.col("importer").rlike(importer) & F.col("imported").rlike(imported)).distinct().orderBy("importer", "imported")


def overlap(importer: str, imported: str, as_packages: bool) -> bool:
    """Whether both ends have a module in common; ends that aren't packages have only when they are one."""
    a, b = importer, imported
    return a == b or as_packages and (a.startswith(b + ".") or b.startswith(a + "."))
