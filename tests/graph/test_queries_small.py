"""Filters, hierarchy and direct imports over small graphs built by hand."""

from copy import deepcopy

import pytest

from edgeloom import ImportGraph
from edgeloom.errors import InvalidImportExpression, InvalidModuleExpression, ModuleNotPresent
from edgeloom.functions.expressions import compile_expression


def build(spark, modules=(), imports=(), squashed=()):
    g = ImportGraph(spark)
    for m in squashed:
        g.add_module(m, is_squashed=True)
    for m in modules:
        g.add_module(m)
    for a, b in imports:
        g.add_import(importer=a, imported=b)
    return g


@pytest.fixture(scope="module")
def tree(spark):
    names = ["foo", "foo.a", "foo.a.one", "foo.b", "foo.b.one", "foo.c", "bar", "bar.g", "gap.x.blue.one.two", "gap.x"]
    return build(spark, names, squashed=["ext"])


def test_hierarchy(tree):
    assert tree.find_children("foo") == {"foo.a", "foo.b", "foo.c"}
    assert tree.find_children("foo.c") == set()
    assert tree.find_descendants("foo") == {"foo.a", "foo.a.one", "foo.b", "foo.b.one", "foo.c"}
    assert tree.find_descendants("gap.x") == {"gap.x.blue.one.two"}
    assert tree.find_children("gap.x") == set()
    assert "gap" not in tree.modules
    for find in (tree.find_children, tree.find_descendants):
        with pytest.raises(ValueError):
            find("ext")
        with pytest.raises(ModuleNotPresent):
            find("gone")


@pytest.mark.parametrize("expression, found", [
    ("foo.a", {"foo.a"}), ("foo.*", {"foo.a", "foo.b", "foo.c"}), ("foo.**", {"foo.a", "foo.a.one", "foo.b", "foo.b.one", "foo.c"}),
    ("*.*.one", {"foo.a.one", "foo.b.one"}), ("**.one", {"foo.a.one", "foo.b.one"}), ("gap.**.two", {"gap.x.blue.one.two"}), ("*", {"foo", "bar", "ext"}), ("nothing", set()),
])
def test_module_expressions(tree, expression, found):
    assert tree.find_matching_modules(expression) == found


@pytest.mark.parametrize("expression", ["", ".", "foo.", ".foo", "foo..a", "foo*", "*foo", "***", "foo.***", "*.**", "**.*", "**.**", "a b", "foo.a\n"])
def test_bad_module_expressions(expression):
    with pytest.raises(InvalidModuleExpression):
        compile_expression(expression)


def test_unicode_and_line_ends(spark):
    g = build(spark, ["ñandú.größe", "foo"])
    assert g.find_matching_modules("ñandú.größe") == {"ñandú.größe"}
    assert g.find_matching_modules("ñandú.*") == {"ñandú.größe"}


@pytest.fixture(scope="module")
def direct(spark):
    g = build(spark, ["a.one", "b"], [("a.one", "b.x"), ("a.one.deep", "b.y"), ("c", "a.one")])
    g.add_import(importer="a.one", imported="b.x", line_number=9, line_contents="from b import x")
    g.add_import(importer="a.one", imported="b.x", line_number=2, line_contents="import b.x")
    g.add_import(importer="a.one", imported="b.x", line_number=2, line_contents="import b.x")
    return g


def test_direct_imports(direct):
    assert direct.direct_import_exists(importer="a.one", imported="b.x")
    assert not direct.direct_import_exists(importer="a.one", imported="b")
    assert direct.direct_import_exists(importer="a.one", imported="b", as_packages=True)
    assert direct.find_modules_directly_imported_by("a.one") == {"b.x"}
    assert direct.find_modules_that_directly_import("a.one") == {"c"}
    assert direct.find_modules_that_directly_import("gone") == set()
    assert direct.count_imports() == 3
    with pytest.raises(ModuleNotPresent):
        direct.find_modules_directly_imported_by("gone")
    with pytest.raises(ValueError, match="shared descendants"):
        direct.direct_import_exists(importer="a.one", imported="a.one.deep", as_packages=True)


def test_details(direct):
    got = direct.get_import_details(importer="a.one", imported="b.x")
    assert [(d["line_number"], d["line_contents"]) for d in got] == [(2, "import b.x"), (9, "from b import x")]
    assert direct.get_import_details(importer="c", imported="a.one") == []
    assert direct.get_import_details(importer="no", imported="where") == []


def test_import_expressions(direct):
    assert direct.find_matching_direct_imports("a.** -> b.*") == [{"importer": "a.one", "imported": "b.x"}, {"importer": "a.one.deep", "imported": "b.y"}]
    for bad in ("a", "a -> b -> c", "a->b", "a* -> b", "a -> **.*"):
        with pytest.raises(InvalidImportExpression):
            direct.find_matching_direct_imports(bad)


def test_line_needs_both(spark):
    with pytest.raises(ValueError):
        ImportGraph(spark).add_import(importer="a", imported="b", line_number=1)


def test_changes(spark):
    g = build(spark, ["a.x.y"], [("a.x", "b"), ("b", "a.x.y"), ("c", "b")])
    copy = deepcopy(g)
    g.remove_module("a.x")
    assert g.modules == {"b", "c"} and g.count_imports() == 1
    g.remove_module("gone")
    g.remove_import(importer="c", imported="b")
    assert g.count_imports() == 0 and g.modules == {"b", "c"}
    assert copy.count_imports() == 3 and copy.modules == {"a.x", "a.x.y", "b", "c"}


def test_squash(spark):
    g = ImportGraph(spark)
    for a, b in [("p.one", "q"), ("p.two", "q"), ("r", "p.one"), ("p.one", "p.two"), ("p", "s"), ("p", "p.two")]:
        g.add_import(importer=a, imported=b, line_number=1, line_contents=f"import {b}")
    g.squash_module("p")
    assert g.modules == {"p", "q", "r", "s"} and g.is_module_squashed("p") and not g.is_module_squashed("q")
    assert {(r.importer, r.imported) for r in g.frames.imports.collect()} == {("p", "q"), ("r", "p"), ("p", "s"), ("p", "p")}
    assert g.get_import_details(importer="p", imported="q") == [] and len(g.get_import_details(importer="p", imported="s")) == 1
    with pytest.raises(ModuleNotPresent):
        g.squash_module("gone")
    with pytest.raises(ValueError):
        g.add_module("p.three")
    with pytest.raises(ValueError):
        g.add_module("q", is_squashed=True)


def test_repr(spark):
    assert repr(ImportGraph(spark)) == "<ImportGraph: empty>"
    assert repr(build(spark, ["one", "two"])) == "<ImportGraph: 'one', 'two'>"
    assert repr(build(spark, "abcdef")).endswith(", ...>")


def test_many_changes(spark):
    g = build(spark, [f"m{i}" for i in range(12)], [(f"m{i}", f"m{i + 1}") for i in range(11)])
    for i in range(10):
        g.remove_import(importer=f"m{i}", imported=f"m{i + 1}")
    assert g.count_imports() == 1
