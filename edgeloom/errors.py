"""Errors that users of the graph can catch."""

from __future__ import annotations


class EdgeloomError(Exception):
    """Base of all errors defined here."""


class ModuleNotPresent(EdgeloomError):
    """The graph has no module of that name."""

    @classmethod
    def named(cls, module: str) -> ModuleNotPresent:
        return cls(f'"{module}" not present in the graph.')


class NoSuchContainer(EdgeloomError):
    """A container of layers is no module of the graph."""


class NamespacePackageEncountered(EdgeloomError):
    """The package has no ``__init__.py`` of its own."""


class NotATopLevelModule(EdgeloomError):
    """The name belongs to a plain module, or to a child of a regular package."""


class InvalidModuleExpression(EdgeloomError):
    """A module expression breaks the rules of ``functions.expressions``."""


class InvalidImportExpression(EdgeloomError):
    """An import expression isn't two module expressions joined by `` -> ``."""


class SourceSyntaxError(EdgeloomError):
    """A source file can't be parsed."""

    def __init__(self, filename: str, lineno: int | None, text: str | None) -> None:
        super().__init__(filename, lineno, text)
        self.filename, self.lineno, self.text = filename, lineno, text

    def __str__(self) -> str:
        return f"Syntax error in {self.filename}, line {self.lineno or '?'}: {self.text or '<unavailable>'}"

    def __eq__(self, other: object) -> bool:
        return isinstance(other, SourceSyntaxError) and self.args == other.args

    __hash__ = EdgeloomError.__hash__
