"""From raw import statements to edges between modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions import names


def is_external(name: Column, packages: list[str]) -> Column:
    inside = F.lit(False)
    for p in packages:
        inside = inside | names.within(name, p)
    return ~inside


def distil_external(name: Column, packages: list[str]) -> Column:
    """What stands in the graph for a name outside all modules; null to leave it out.

    A name above one of the packages is left out.  A name that shares its root
    with a package inside a namespace becomes its shortest prefix that is no
    namespace of such packages; where it lies in a package, that package.  Any
    other name becomes its root.  The packages are the few that the user named,
    so all of this is one expression of their prefixes.
    """
    above = sorted({p.rsplit(".", n)[0] for p in packages for n in range(1, p.count(".") + 1)})
    kept = F.lit(1)
    for p in sorted(packages):
        parts = p.split(".")
        if len(parts) > 1:
            shared = F.lit(1)
            for n in range(1, len(parts) + 1):
                shared = F.when(names.within(name, ".".join(parts[:n])), min(n + 1, len(parts))).otherwise(shared)
            kept = F.greatest(kept, shared)
    return F.when(~name.isin(above) if above else F.lit(True), F.call_function("substring_index", name, F.lit("."), kept))


def resolve_imports(raw: DataFrame, files: DataFrame, packages: list[str], include_external: bool = False, exclude_type_checking: bool = False) -> DataFrame:
    """(importer, imported, line_number, line_contents), distinct.

    ``raw`` has path, object_name, line_number, line_contents and
    typechecking_only; ``files`` has module, path and is_package.  A name is the
    module of that very name, else the module one level up, else external.
    """
    used = raw.where("object_name is not null")
    if exclude_type_checking:
        used = used.where(~F.col("typechecking_only"))
    placed = used.join(files.select("path", F.col("module").alias("importer"), "is_package"), "path")
    named = placed.withColumn("name", names.absolute(F.col("importer"), F.col("is_package"), F.col("object_name"))).where("name is not null")
    exact, upper = files.select(F.col("module").alias("_exact")), files.select(F.col("module").alias("_upper"))
    met = named.join(exact, F.col("name") == F.col("_exact"), "left").join(upper, names.parent(F.col("name")) == F.col("_upper"), "left")
    internal = F.coalesce("_exact", "_upper")
    imported = F.coalesce(internal, distil_external(F.col("name"), packages)) if include_external else internal
    found = met.select("importer", imported.alias("imported"), "line_number", "line_contents")
    return found.where("imported is not null").distinct()
