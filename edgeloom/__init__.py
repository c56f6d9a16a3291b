"""Dependency graphs of dotted module names, on Spark."""

from edgeloom.graph import DetailedImport, Import, ImportGraph
from edgeloom.model import DirectImport, Layer, Module, PackageDependency, Route
from edgeloom.plans.build import build_graph

__all__ = ["DetailedImport", "DirectImport", "Import", "ImportGraph", "Layer", "Module", "PackageDependency", "Route", "build_graph"]
