"""``build_graph``: find, scan, resolve, assemble."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.errors import SourceSyntaxError
from edgeloom.functions.parse import parse_imports_udtf
from edgeloom.graph import ImportGraph
from edgeloom.plans.frames import Frames
from edgeloom.plans.resolve import is_external, resolve_imports
from edgeloom.sources import cache
from edgeloom.sources.discovery import find_modules, package_directory
from edgeloom.sources.reader import read_sources
from edgeloom.storage import materialize

FILES = "package string, directory string, module string, path string, is_package boolean, mtime double"


class NotSupplied:
    """The default of ``cache_dir``: the default folder.  None means no cache."""


def scan(sources: DataFrame) -> DataFrame:
    """(path, object_name, line_number, line_contents, typechecking_only, error_line, error_text) of (path, content).

    A source without imports keeps one row, without a name.
    """
    spark = sources.sparkSession
    spark.udtf.register("edgeloom_parse_imports", parse_imports_udtf)
    found = spark.sql("select s.path, t.* from {sources} s, lateral edgeloom_parse_imports(s.content) t", sources=sources)
    return sources.select("path").join(found, "path", "left")


def checked(raw: DataFrame) -> DataFrame:
    """``raw``, or the first error by path."""
    bad = raw.where("error_line is not null").orderBy("path").limit(1).collect()
    if bad:
        raise SourceSyntaxError(filename=bad[0].path, lineno=bad[0].error_line, text=bad[0].error_text)
    return raw.drop("error_line", "error_text")


def assemble(files: DataFrame, edges: DataFrame, packages: list[str]) -> Frames:
    """The relations of a graph: every file's module, every import's ends; ends outside the packages are squashed."""
    inside = files.select(F.col("module").alias("name"), F.lit(False).alias("is_squashed"))
    ends = edges.select(F.col("imported").alias("name")).distinct().withColumn("is_squashed", is_external(F.col("name"), packages))
    modules = inside.unionAll(ends).groupBy("name").agg(F.bool_and("is_squashed").alias("is_squashed"))
    return Frames(modules, edges.select("importer", "imported").distinct(), edges.select("importer", "imported", "line_number", "line_contents"))


def graph_of_sources(files: DataFrame, sources: DataFrame, packages: list[str], include_external_packages: bool = False, exclude_type_checking_imports: bool = False) -> ImportGraph:
    """A graph of texts in a DataFrame (path, content), with ``files`` as ``build_graph`` finds them on disk."""
    raw = checked(materialize(scan(sources), "scan"))
    edges = resolve_imports(raw, files, packages, bool(include_external_packages), exclude_type_checking_imports)
    return ImportGraph.of_frames(assemble(files, edges, packages).materialized())


def build_graph(package_name: str, *additional_package_names: str, include_external_packages: bool = False, exclude_type_checking_imports: bool = False, cache_dir: str | type[NotSupplied] | None = NotSupplied, spark: SparkSession | None = None) -> ImportGraph:
    """The graph of one or more importable packages.

    ``cache_dir`` names the folder of the cached scan (None: no cache); only
    files that are new or changed since are read and parsed.
    """
    packages = [package_name, *additional_package_names]
    for name in packages:
        if not isinstance(name, str):
            raise TypeError(f"Package names must be strings, got {type(name).__name__}.")
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    found = [m for p in dict.fromkeys(packages) for m in find_modules(p, package_directory(p))]
    files = spark.createDataFrame([(m.package, m.directory, m.module, m.path, m.is_package, m.mtime) for m in found], FILES)
    folder = cache.DEFAULT_DIR if cache_dir is NotSupplied else cache_dir
    cached = cache.read(spark, folder, packages) if folder else spark.createDataFrame([], cache.SCHEMA)
    old = cache.hits(files, cached)
    missing = sorted(r.path for r in cache.misses(files, cached).select("path").collect()) if folder else [m.path for m in found]
    rows = old
    if missing:
        sources = materialize(read_sources(spark, missing), "sources")
        if bad := sources.where("error is not null").orderBy("path").limit(1).collect():
            raise UnicodeError(f"Failed to decode file {bad[0].path} ({bad[0].error})")
        new = checked(materialize(scan(sources.select("path", "content")), "scan"))
        rows = old.unionByName(new.join(files.select("path", "mtime"), "path"))
    if folder and missing:
        cache.write(rows, folder, packages)
    edges = resolve_imports(rows, files, packages, bool(include_external_packages), exclude_type_checking_imports)
    return ImportGraph.of_frames(assemble(files, edges, packages).materialized())
