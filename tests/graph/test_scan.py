"""Parsing, resolving, discovery, the data source and the cache."""

import os
import sys
import textwrap

import pytest

from edgeloom import Layer, Module, build_graph
from edgeloom.errors import NamespacePackageEncountered, NotATopLevelModule, SourceSyntaxError
from edgeloom.functions.parse import parse_imports
from edgeloom.model import DirectImport
from edgeloom.plans.build import graph_of_sources
from edgeloom.plans.resolve import distil_external
from edgeloom.sources.discovery import find_modules, is_source, module_name
from edgeloom.sources.reader import decode


@pytest.mark.parametrize("code, found", [
    ("import a.b as c, d", [("a.b", 1, False), ("d", 1, False)]),
    ("from . import x\nfrom ..m import y, z", [(".x", 1, False), ("..m.y", 2, False), ("..m.z", 2, False)]),
    ("from .m import *", [(".m.*", 1, False)]),
    ("from m import (\n  a,\n  b,\n)", [("m.a", 1, False), ("m.b", 1, False)]),
    ("def f():\n  class C:\n    import a\n", [("a", 3, False)]),
    ("try:\n  import a\nexcept E:\n  import b\nelse:\n  import c\nfinally:\n  import d", [("a", 2, False), ("b", 4, False), ("c", 6, False), ("d", 8, False)]),
    ("match x:\n  case 1:\n    import a", [("a", 3, False)]),
    ("if TYPE_CHECKING:\n  import a\nelse:\n  import b\nimport c", [("a", 2, True), ("b", 4, True), ("c", 5, False)]),
    ("if t.TYPE_CHECKING:\n  import a", [("a", 2, True)]),
    ("if not TYPE_CHECKING:\n  import a", [("a", 2, False)]),
    ("if x:\n  pass\nelif TYPE_CHECKING:\n  import a", [("a", 4, False)]),
    ("if TYPE_CHECKING:\n  if TYPE_CHECKING:\n    import a\n  import b", [("a", 3, True), ("b", 4, False)]),
    ("while TYPE_CHECKING:\n  import a", [("a", 2, False)]),
    ("s = 'import a'\n# import b", []),
    ("x = 1; import a", [("a", 1, False)]),
    ("s = '''\n\x0c'''\nimport a", [("a", 3, False)]),
    ("", []),
])
def test_parse(code, found):
    assert [(n, line, guarded) for n, line, _, guarded in parse_imports(code)] == found


def test_parse_text_of_line():
    assert parse_imports("def f():\r\n    from a import (  # why\r\n  b)")[0][2] == "from a import (  # why"
    with pytest.raises(SyntaxError):
        parse_imports("from import")


@pytest.mark.parametrize("data, text", [(b"x = '\xc3\xa9'", "x = 'é'"), (b"# -*- coding: latin-1 -*-\nx = '\xe9'", "# -*- coding: latin-1 -*-\nx = 'é'"), ("# coding: shift_jis\nx = 'あ'".encode("shift_jis"), "# coding: shift_jis\nx = 'あ'")])
def test_decode(data, text):
    assert decode(data) == text


def test_decode_errors():
    for bad in (b"\xff\xfe", b"\n\n# coding: latin-1\n\xe9"):
        with pytest.raises(UnicodeDecodeError):
            decode(bad)
    with pytest.raises(LookupError):
        decode(b"# coding: nonesuch")


@pytest.mark.parametrize("packages, name, expected", [
    (["foo"], "bar.one.two", "bar"), (["foo"], "foo.x.y.z", "foo"), (["foo.bar"], "foo", None), (["foo.bar.baz"], "foo.bar", None),
    (["foo.blue.beta"], "foo.blue.alpha.one", "foo.blue.alpha"), (["foo.green"], "foo.blue.alpha.one", "foo.blue"), (["foo.green", "foo.blue.beta"], "foo.blue.alpha.one", "foo.blue.alpha"),
    (["foo.green"], "foobar.x", "foobar"), (["foo.green"], "foo.green.gone.deep", "foo.green"), (["foo.green"], "foo.greenish", "foo.greenish"),
])
def test_distil(spark, packages, name, expected):
    df = spark.createDataFrame([(name,)], "name string")
    assert df.select(distil_external(df.name, packages)).first()[0] == expected


def in_memory(spark, sources, packages, **options):
    rows = []
    for path in sources:
        package = max((p for p in packages if path.startswith(p.replace(".", "/") + "/")), key=len)
        name = module_name(package, path[len(package) + 1:].replace("/", os.sep))
        rows.append((package, "", name, path, path.endswith("__init__.py"), 0.0))
    files = spark.createDataFrame(rows, "package string, directory string, module string, path string, is_package boolean, mtime double")
    texts = spark.createDataFrame([(p, c) for p, c in sources.items()], "path string, content string")
    return graph_of_sources(files, texts, packages, **options)


def test_resolution(spark):
    sources = {
        "foo/__init__.py": "from . import one\nfrom . import *\nfrom ... import high",
        "foo/one.py": "import foo.two.alpha\nfrom foo.two.alpha import thing\nfrom foo.two.gone.deep import x\nimport django.db.models",
        "foo/two/__init__.py": "from .alpha import *\nfrom .. import one\nfrom ..one import f",
        "foo/two/alpha.py": "from . import beta\nif TYPE_CHECKING:\n    from ..one import x",
        "foo/two/beta.py": "",
    }
    edges = {("foo", "foo.one"), ("foo", "foo"), ("foo.one", "foo.two.alpha"), ("foo.two", "foo.two.alpha"), ("foo.two", "foo.one"), ("foo.two", "foo"), ("foo.two.alpha", "foo.two.beta"), ("foo.two.alpha", "foo.one")}
    edges -= {("foo.two", "foo")}
    got = in_memory(spark, sources, ["foo"])
    assert {(r.importer, r.imported) for r in got.frames.imports.collect()} == edges
    assert got.modules == {"foo", "foo.one", "foo.two", "foo.two.alpha", "foo.two.beta"}
    assert [d["line_number"] for d in got.get_import_details(importer="foo.one", imported="foo.two.alpha")] == [1, 2]
    got = in_memory(spark, sources, ["foo"], include_external_packages=True, exclude_type_checking_imports=True)
    assert {(r.importer, r.imported) for r in got.frames.imports.collect()} == edges - {("foo.two.alpha", "foo.one")} | {("foo.one", "django"), ("foo.one", "foo")}
    assert got.is_module_squashed("django") and not got.is_module_squashed("foo")


def test_syntax_error(spark):
    with pytest.raises(SourceSyntaxError) as e:
        in_memory(spark, {"foo/__init__.py": "", "foo/bad.py": "x = 1\n  from import y  ", "foo/worse.py": "("}, ["foo"])
    assert e.value == SourceSyntaxError(filename="foo/bad.py", lineno=2, text="from import y") and "line 2" in str(e.value)


@pytest.fixture
def disk(tmp_path, monkeypatch):
    def write(files):
        for path, text in files.items():
            target = tmp_path / path
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(textwrap.dedent(text))
        return tmp_path

    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.chdir(tmp_path)
    yield write
    for m in [m for m in sys.modules if m.startswith(("pkgx", "nsx"))]:
        del sys.modules[m]


def test_discovery(disk):
    root = disk({f"pkgx/{f}": "" for f in ("__init__.py", "a.py", "b.c.py", ".hidden.py", "data.txt", "sub/__init__.py", "sub/d.py", "bare/e.py", "bare/in/__init__.py", ".dot/__init__.py", "twice.py", "twice/__init__.py")})
    found = {m.module: m for m in find_modules("pkgx", str(root / "pkgx"))}
    assert set(found) == {"pkgx", "pkgx.a", "pkgx.sub", "pkgx.sub.d", "pkgx.twice"}
    assert found["pkgx"].is_package and not found["pkgx.twice"].is_package
    assert not is_source("x.txt") and is_source("x.py")


def test_build_and_cache(spark, disk):
    root = disk({"pkgx/__init__.py": "", "pkgx/one.py": "import pkgx.two", "pkgx/two.py": "import os.path", "nsx/part/__init__.py": "from pkgx import one\nfrom nsx.other.deep import y"})
    both = build_graph("pkgx", "nsx.part", include_external_packages=True, spark=spark)
    assert {(r.importer, r.imported) for r in both.frames.imports.collect()} == {("pkgx.one", "pkgx.two"), ("pkgx.two", "os"), ("nsx.part", "pkgx.one"), ("nsx.part", "nsx.other")}
    assert (root / ".edgeloom_cache" / "CACHEDIR.TAG").exists()
    # an unchanged file isn't read again, a changed one is, whatever the options
    stamp = os.stat(root / "pkgx/one.py")
    (root / "pkgx/one.py").write_text("import pkgx.gone")
    os.utime(root / "pkgx/one.py", ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
    (root / "pkgx/two.py").write_text("import pkgx.one")
    os.utime(root / "pkgx/two.py", (1, 1))
    again = build_graph("pkgx", "nsx.part", spark=spark)
    assert {(r.importer, r.imported) for r in again.frames.imports.collect()} == {("pkgx.one", "pkgx.two"), ("pkgx.two", "pkgx.one"), ("nsx.part", "pkgx.one")}
    fresh = build_graph("pkgx", cache_dir=None, spark=spark)
    assert {(r.importer, r.imported) for r in fresh.frames.imports.collect()} == {("pkgx.one", "pkgx"), ("pkgx.two", "pkgx.one")}


def test_corrupt_cache(spark, disk):
    root = disk({"pkgx/__init__.py": "import os"})
    build_graph("pkgx", cache_dir=str(root / "c"), spark=spark)
    for f in (root / "c").rglob("*.parquet"):
        f.write_bytes(b"nothing")
    assert build_graph("pkgx", cache_dir=str(root / "c"), include_external_packages=True, spark=spark).modules == {"pkgx", "os"}


def test_build_errors(spark, disk):
    root = disk({"pkgx/__init__.py": "", "pkgx/sub/__init__.py": "", "pkgxmod.py": "", "nsx/part/__init__.py": "", "pkgxbad/__init__.py": ""})
    (root / "pkgxbad/__init__.py").write_bytes(b"\xff")
    with pytest.raises(TypeError, match="got bool"):
        build_graph("pkgx", True, spark=spark)
    with pytest.raises(ValueError, match="Could not find"):
        build_graph("pkgxnone", spark=spark)
    with pytest.raises(NamespacePackageEncountered):
        build_graph("nsx", spark=spark)
    for name in ("pkgx.sub", "pkgxmod"):
        with pytest.raises(NotATopLevelModule):
            build_graph(name, spark=spark)
    with pytest.raises(UnicodeError):
        build_graph("pkgxbad", cache_dir=None, spark=spark)


def test_values():
    m = Module("a.b.c")
    assert (m.package_name, m.root, m.parent) == ("a", Module("a"), Module("a.b"))
    assert m.is_child_of(Module("a.b")) and not Module("a").is_child_of(m) and m.is_descendant_of(Module("a")) and not m.is_descendant_of(m)
    with pytest.raises(ValueError):
        Module("a").parent
    assert str(DirectImport(importer=m, imported=Module("x"), line_number=3, line_contents="import x")) == "a.b.c -> x (l. 3)"
    assert hash(Layer("a", "b")) == hash(Layer("b", "a")) and {Layer("a")} == {Layer("a")} and Layer("a") != Layer("a", closed=True)
    assert str(Layer("b", "a", closed=True)) == "['a', 'b'], independent=True, closed=True"
