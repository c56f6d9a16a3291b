"""Module expressions: ``*`` stands for one component, ``**`` for one or more."""

from __future__ import annotations

import re

from pyspark.sql import Column

from edgeloom.errors import InvalidImportExpression, InvalidModuleExpression

#: One component of a name, as Java's and Python's expressions both read it.
COMPONENT = r"[^\.]+"


def compile_expression(expression: str) -> str:
    """A Java regular expression for whole names; raises on expressions that the rules forbid.

    Each component is a word, ``*`` or ``**``; next to ``**`` stands a word only.
    """
    parts = expression.split(".")
    wild = {"*": COMPONENT, "**": rf"{COMPONENT}(?:\.{COMPONENT})*"}
    for i, part in enumerate(parts):
        beside = parts[i + 1 : i + 2]
        if not (part in wild or re.fullmatch(r"\w+", part)) or (beside and {part, beside[0]} <= wild.keys() and "**" in (part, beside[0])):
            raise InvalidModuleExpression(f"{expression} is not a valid module expression.")
    return r"(?U)\A" + r"\.".join(wild.get(p, p) for p in parts) + r"\z"


def matches(name: Column, expression: str) -> Column:
    return name.rlike(compile_expression(expression))


def compile_import_expression(expression: str) -> tuple[str, str]:
    """The expressions of both ends of ``importer -> imported``."""
    ends = expression.split(" -> ")
    try:
        importer, imported = map(compile_expression, ends)
    except (ValueError, InvalidModuleExpression) as e:
        raise InvalidImportExpression(f"{expression} is not a valid import expression.") from e
    return importer, imported
