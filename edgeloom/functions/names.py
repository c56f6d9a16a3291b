"""Dotted names as columns.

A module's descendants are exactly the names that start with its name and a dot,
so no table of the hierarchy is kept.  To match many packages with many modules,
``ancestors`` turns the prefix test into keys of a hash join.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def root(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def parent(name: Column) -> Column:
    """The name without its last component; null at a root."""
    return F.nullif(F.regexp_extract(name, r"^(.*)\.[^.]*$", 1), F.lit(""))


def depth(name: Column) -> Column:
    return F.length(name) - F.length(F.replace(name, F.lit("."), F.lit(""))) + 1


def within(name: Column, package: str) -> Column:
    """The package itself or any descendant; both tests reach a Parquet scan."""
    return (name == package) | name.startswith(package + ".")


def below(name: Column, package: str) -> Column:
    return name.startswith(package + ".")


def self_and_ancestors(name: Column) -> Column:
    """All prefixes of a name at component borders, the shortest first."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def child_of(name: Column, package: str) -> Column:
    """The child of ``package`` that a name is or lies under; null outside the package."""
    skip = len(package) + 2
    return F.when(below(name, package), F.concat(F.lit(package + "."), F.substring_index(F.substring(name, skip, 1 << 30), ".", 1)))


def leading_dots(name: Column) -> Column:
    return F.length(F.regexp_extract(name, r"^(\.*)", 1))


def absolute(module: Column, is_package: Column, name: Column) -> Column:
    """An imported name made absolute; null where its dots climb above the root."""
    dots, parts = leading_dots(name), F.split(module, r"\.")
    keep = F.size(parts) - dots + F.when(is_package, 1).otherwise(0)
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(keep, F.lit(0))), ".")
    return F.when(dots == 0, name).when(keep > 0, F.concat(base, F.lit("."), F.substring(name, dots + 1, F.lit(1 << 30))))


def describe_import(importer: Column, imported: Column, line_number: Column) -> Column:
    return F.format_string("%s -> %s (l. %d)", importer, imported, line_number)
