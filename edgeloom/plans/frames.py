"""The three relations of a graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from edgeloom.storage import materialize

MODULES = "name string, is_squashed boolean"
IMPORTS = "importer string, imported string"
DETAILS = "importer string, imported string, line_number int, line_contents string"


@dataclass(frozen=True)
class Frames:
    """``modules`` (one row a name), ``imports`` (one row an edge) and ``details`` (distinct rows)."""

    modules: DataFrame
    imports: DataFrame
    details: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Frames:
        return cls(*(spark.createDataFrame([], s) for s in (MODULES, IMPORTS, DETAILS)))

    @classmethod
    def of_rows(cls, spark: SparkSession, modules, imports, details) -> Frames:
        return cls(*(spark.createDataFrame(list(rows), s) for rows, s in ((modules, MODULES), (imports, IMPORTS), (details, DETAILS))))

    def materialized(self) -> Frames:
        return Frames(materialize(self.modules, "modules"), materialize(self.imports, "imports"), materialize(self.details, "details"))
