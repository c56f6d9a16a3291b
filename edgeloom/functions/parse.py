"""Import statements of Python source, as a table function."""

from __future__ import annotations

import ast
import re

from pyspark.sql import functions as F

#: Line ends of Python source; ``str.splitlines`` knows more than these.
LINE_END = re.compile(r"\r\n|\r|\n")
GUARD = "TYPE_CHECKING"
SCHEMA = "object_name string, line_number int, line_contents string, typechecking_only boolean, error_line int, error_text string"


def _is_guard(test: ast.expr) -> bool:
    return isinstance(test, ast.Name) and test.id == GUARD or isinstance(test, ast.Attribute) and test.attr == GUARD


def _statements(nodes: list[ast.stmt], guarded: bool):
    """(statement, under a guard) in order, with an explicit stack so deep nesting is no limit.

    A guard's flag covers the whole statement, its other branches too, and is
    off, not restored, after a guard inside a guard.
    """
    state = [guarded]
    stack: list = list(reversed(nodes))
    while stack:
        node = stack.pop()
        if node is _OFF:
            state[0] = False
            continue
        yield node, state[0]
        inner = []
        for field in ("body", "handlers", "cases", "orelse", "finalbody"):
            for x in getattr(node, field, None) or []:
                # ``elif`` is an If in ``orelse`` at its parent's column: its test is no guard
                if isinstance(node, ast.If) and field == "orelse" and isinstance(x, ast.If) and x.col_offset == node.col_offset and len(node.orelse) == 1:
                    x.is_elif = True
                inner.append(x)
        if isinstance(node, ast.If) and not getattr(node, "is_elif", False) and _is_guard(node.test):
            state[0] = True
            stack.append(_OFF)
        stack.extend(reversed(inner))


_OFF = object()


def parse_imports(code: str) -> list[tuple[str, int, str, bool]]:
    """(object name, line, that line stripped, type checking only) of every import at any depth; raises SyntaxError."""
    lines = LINE_END.split(code)
    out = []
    for node, guarded in _statements(ast.parse(code).body, False):
        if isinstance(node, ast.Import):
            names = [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            base = "." * node.level + (node.module + "." if node.module else "")
            names = [base + a.name for a in node.names]
        else:
            continue
        text = lines[node.lineno - 1].strip() if node.lineno <= len(lines) else ""
        out += [(name, node.lineno, text, guarded) for name in names]
    return out


class ParseImports:
    """Rows of one source text; a text that can't be parsed gives one row with the error's line and text."""

    def eval(self, code: str):
        try:
            for name, line, text, guarded in parse_imports(code or ""):
                yield name, line, text, guarded, None, None
        except (SyntaxError, ValueError, RecursionError) as e:
            line = getattr(e, "lineno", None) or 1
            lines = LINE_END.split(code or "")
            yield None, None, None, None, line, lines[line - 1].strip() if 0 < line <= len(lines) else ""


#: ``select ... from sources, lateral parse_imports(content)`` once registered.
parse_imports_udtf = F.udtf(ParseImports, returnType=SCHEMA)
