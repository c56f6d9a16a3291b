"""``ImportGraph``: the graph as users hold it.

Every query has a form that returns a DataFrame (``*_df``) and one that collects
the answer.  Changes go to rows on the driver first, so that errors come at
once, and join the frames with the next query; the frames themselves are never
changed, so a copy shares them.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import TypedDict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.errors import ModuleNotPresent, NoSuchContainer
from edgeloom.functions import names
from edgeloom.model import Layer, PackageDependency, Route
from edgeloom.operators import chains, cycles, direct, hierarchy, layers, mutation, reach
from edgeloom.plans.frames import Frames


class Import(TypedDict):
    importer: str
    imported: str


class DetailedImport(Import):
    line_number: int
    line_contents: str


#: Changes of whole frames after which their lineage is cut.
MOST_PENDING = 8


def _above(module: str) -> list[str]:
    return [module.rsplit(".", n)[0] for n in range(1, module.count(".") + 1)]


class ImportGraph:
    """A directed graph of imports between modules."""

    def __init__(self, spark: SparkSession | None = None) -> None:
        self._spark = spark
        self._frames: Frames | None = None
        self._squashed: dict[str, bool] | None = {}  # names and flags on the driver; None until a change asks for them
        self._added: tuple[dict, dict, dict] = ({}, {}, {})  # modules, imports, details that the frames lack
        self._pending = 0

    # Frames

    @classmethod
    def of_frames(cls, frames: Frames) -> ImportGraph:
        graph = cls(frames.modules.sparkSession)
        graph._frames, graph._squashed = frames, None
        return graph

    @classmethod
    def from_frames(cls, modules: DataFrame, imports: DataFrame, details: DataFrame | None = None) -> ImportGraph:
        """A graph of modules (name, is_squashed), imports (importer, imported) and, where known, their lines."""
        details = details if details is not None else imports.limit(0).selectExpr("importer", "imported", "cast(null as int) line_number", "cast(null as string) line_contents")
        return cls.of_frames(Frames(modules, imports, details))

    @property
    def spark(self) -> SparkSession:
        if self._spark is None:
            self._spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        return self._spark

    @property
    def frames(self) -> Frames:
        """The relations with all changes."""
        if self._frames is None:
            self._frames = Frames.empty(self.spark)
        if any(self._added):
            modules, imports, details = self._added
            self._frames = mutation.add(self._frames, modules.items(), imports, details)
            self._added = ({}, {}, {})
            self._changed()
        return self._frames

    def _changed(self) -> None:
        self._pending += 1
        if self._pending >= MOST_PENDING:
            self._frames, self._pending = self._frames.materialized(), 0

    def _change(self, frames: Frames) -> None:
        self._frames = frames
        self._changed()

    @property
    def _names(self) -> dict[str, bool]:
        """Names and flags on the driver: only asked for by changes and by lookups of a graph built by hand."""
        if self._squashed is None:
            self._squashed = {r.name: r.is_squashed for r in self._frames.modules.collect()}
        return self._squashed

    def _flag(self, module: str) -> bool | None:
        """Whether a module is squashed; None if there is no such module."""
        if self._squashed is not None:
            return self._squashed.get(module)
        row = self.frames.modules.where(F.col("name") == module).select("is_squashed").first()
        return None if row is None else row.is_squashed

    def _present(self, wanted: Iterable[str]) -> set[str]:
        """Those of a user's names that are modules, looked up in one job."""
        wanted = set(wanted)
        if self._squashed is not None:
            return wanted & self._squashed.keys()
        return _names_of(self.frames.modules.where(F.col("name").isin(sorted(wanted))).select("name")) if wanted else set()

    def _need(self, *modules: str, error: type[Exception] = ModuleNotPresent) -> None:
        for m in modules:
            if self._flag(m) is None:
                raise ModuleNotPresent.named(m) if error is ModuleNotPresent else error(f"Module {m} is not present in the graph.")

    # Mechanics

    @property
    def modules(self) -> set[str]:
        return set(self._names)

    @property
    def modules_df(self) -> DataFrame:
        return self.frames.modules.select("name")

    def contains_module(self, module: str) -> bool:
        return self._flag(module) is not None

    def find_matching_modules_df(self, expression: str) -> DataFrame:
        return hierarchy.matching(self.frames.modules, expression)

    def find_matching_modules(self, expression: str) -> set[str]:
        """Modules that an expression matches: ``*`` is one component of a name, ``**`` one or more."""
        return _names_of(self.find_matching_modules_df(expression))

    def add_module(self, module: str, is_squashed: bool = False) -> None:
        known = self._names
        for above in _above(module):
            if known.get(above):
                raise ValueError(f"Module is a descendant of squashed module {above}.")
        if known.get(module, is_squashed) != is_squashed:
            raise ValueError("Cannot add a squashed module when it is already present in the graph as an unsquashed module, or vice versa.")
        if module not in known:
            if is_squashed and any(m.startswith(module + ".") for m in known):
                raise ValueError(f"Cannot add {module} as a squashed module: the graph has modules below it.")
            known[module] = self._added[0][module] = is_squashed

    def remove_module(self, module: str) -> None:
        """Remove a module and all below it; nothing happens where there is none."""
        gone = [m for m in self._names if m == module or m.startswith(module + ".")]
        if gone:
            self._change(mutation.remove_module(self.frames, module))
            for m in gone:
                del self._squashed[m]

    def squash_module(self, module: str) -> None:
        """Let a module stand for itself and all below it."""
        self._need(module)
        below = [m for m in self._names if m.startswith(module + ".")]
        self._change(mutation.squash_module(self.frames, module))
        for m in below:
            del self._squashed[m]
        self._squashed[module] = True

    def is_module_squashed(self, module: str) -> bool:
        self._need(module)
        return bool(self._flag(module))

    def add_import(self, *, importer: str, imported: str, line_number: int | None = None, line_contents: str | None = None) -> None:
        """Add an import, and its ends where they are missing; its line needs both number and contents."""
        if (line_number is None) != (line_contents is None):
            raise ValueError("line_number and line_contents go together.")
        for end in (importer, imported):
            if end not in self._names:
                self._names[end] = self._added[0][end] = False
        self._added[1][importer, imported] = None
        if line_number is not None:
            self._added[2][importer, imported, line_number, line_contents] = None

    def remove_import(self, *, importer: str, imported: str) -> None:
        """Remove an import and its lines, not its modules."""
        self._need(importer, imported)
        self._change(mutation.remove_import(self.frames, importer, imported))

    def count_imports(self) -> int:
        return self.frames.imports.count()

    # Hierarchy

    def find_children_df(self, module: str) -> DataFrame:
        return hierarchy.children(self.frames.modules, module)

    def find_children(self, module: str) -> set[str]:
        if self.is_module_squashed(module):
            raise ValueError("Cannot find children of a squashed module.")
        return _names_of(self.find_children_df(module))

    def find_descendants_df(self, module: str) -> DataFrame:
        return hierarchy.descendants(self.frames.modules, module)

    def find_descendants(self, module: str) -> set[str]:
        if self.is_module_squashed(module):
            raise ValueError("Cannot find descendants of a squashed module.")
        return _names_of(self.find_descendants_df(module))

    # Direct imports

    def direct_import_exists(self, *, importer: str, imported: str, as_packages: bool = False) -> bool:
        self._need(importer, imported)
        if as_packages:
            _apart(importer, imported, True)
        return not direct.between(self.frames.imports, importer, imported, as_packages).isEmpty()

    def find_modules_directly_imported_by_df(self, module: str) -> DataFrame:
        return direct.imported_by(self.frames.imports, module)

    def find_modules_directly_imported_by(self, module: str) -> set[str]:
        self._need(module)
        return _names_of(self.find_modules_directly_imported_by_df(module))

    def find_modules_that_directly_import_df(self, module: str) -> DataFrame:
        return direct.importers_of(self.frames.imports, module)

    def find_modules_that_directly_import(self, module: str) -> set[str]:
        """Importers of a module; none, and no error, where the graph lacks it."""
        return _names_of(self.find_modules_that_directly_import_df(module))

    def get_import_details_df(self, *, importer: str, imported: str) -> DataFrame:
        return direct.details_of(self.frames.details, importer, imported)

    def get_import_details(self, *, importer: str, imported: str) -> list[DetailedImport]:
        """The known lines of an import, by number; none where there is no import or no line is known."""
        rows = self.get_import_details_df(importer=importer, imported=imported).collect()
        return [DetailedImport(importer=r.importer, imported=r.imported, line_number=r.line_number, line_contents=r.line_contents) for r in rows]

    def find_matching_direct_imports_df(self, import_expression: str) -> DataFrame:
        return direct.matching(self.frames.imports, import_expression)

    def find_matching_direct_imports(self, import_expression: str) -> list[Import]:
        """Imports whose ends match ``importer -> imported``, in order of both."""
        return [Import(importer=r.importer, imported=r.imported) for r in self.find_matching_direct_imports_df(import_expression).collect()]

    # Indirect imports

    def _starts(self, module: str, as_package: bool) -> DataFrame:
        name = F.col("name")
        return self.frames.modules.where(names.within(name, module) if as_package else name == module).select(F.lit(0).cast("long").alias("group"), "name")

    def find_upstream_modules_df(self, module: str, as_package: bool = False) -> DataFrame:
        return reach.find_reach(self.frames.imports, self._starts(module, as_package), upstream=True).select("name")

    def find_upstream_modules(self, module: str, as_package: bool = False) -> set[str]:
        """All that a module, or a package as a whole, imports, however indirectly."""
        self._need(module)
        return _names_of(self.find_upstream_modules_df(module, as_package))

    def find_downstream_modules_df(self, module: str, as_package: bool = False) -> DataFrame:
        return reach.find_reach(self.frames.imports, self._starts(module, as_package), upstream=False).select("name")

    def find_downstream_modules(self, module: str, as_package: bool = False) -> set[str]:
        """All that imports a module, or any module of a package, however indirectly."""
        self._need(module)
        return _names_of(self.find_downstream_modules_df(module, as_package))

    def _chains_df(self, importer: str, imported: str, as_packages: bool, every: bool) -> DataFrame:
        sides = [self._starts(m, as_packages).select("group", F.lit(role).alias("role"), "name") for m, role in ((importer, "head"), (imported, "tail"))]
        return chains.find_chains(self.frames.imports, sides[0].unionAll(sides[1]), every).select("chain")

    def find_shortest_chain(self, importer: str, imported: str, as_packages: bool = False) -> tuple[str, ...] | None:
        """A shortest chain of imports, of equal ones the smallest by name; None where there is none."""
        self._need(importer, imported, error=ValueError)
        _apart(importer, imported, as_packages)
        row = self._chains_df(importer, imported, as_packages, every=False).first()
        return tuple(row.chain) if row else None

    def find_shortest_chains_df(self, importer: str, imported: str, as_packages: bool = True) -> DataFrame:
        return self._chains_df(importer, imported, as_packages, every=True)

    def find_shortest_chains(self, importer: str, imported: str, as_packages: bool = True) -> set[tuple[str, ...]]:
        """Chains without common edges, each the shortest that those before it leave."""
        self._need(importer, imported)
        _apart(importer, imported, as_packages)
        return {tuple(r.chain) for r in self.find_shortest_chains_df(importer, imported, as_packages).collect()}

    def chain_exists(self, importer: str, imported: str, as_packages: bool = False) -> bool:
        self._need(importer, imported)
        _apart(importer, imported, as_packages)
        target = F.col("name")
        found = reach.find_reach(self.frames.imports, self._starts(importer, as_packages), stop_at=self._starts(imported, as_packages))
        return not found.where(names.within(target, imported) if as_packages else target == imported).isEmpty()

    # Architecture

    def find_illegal_dependencies_for_layers_df(self, layers_: Sequence[Layer | str | Iterable[str]], containers: Iterable[str] | None = None) -> DataFrame:
        """(importer, imported, heads, middle, tails) of every illegal route."""
        levels = layers.level_rows(self.spark, [Layer.of(x) for x in layers_], containers or ())
        return layers.illegal_routes(self.frames, levels)

    def find_illegal_dependencies_for_layers(self, layers: Sequence[Layer | str | Iterable[str]], containers: Iterable[str] | None = None) -> set[PackageDependency]:
        """Dependencies from lower layers to higher ones, between independent siblings, and past closed layers.

        Layers stand from high to low; those that the graph lacks are passed
        over.  With containers, the names are relative to each of them.
        """
        containers = sorted(containers or ())
        known = self._present(containers)
        for c in containers:
            if c not in known:
                raise NoSuchContainer(f"Container {c} does not exist.")
        self._check_apart([Layer.of(x) for x in layers], containers)
        found: dict[tuple[str, str], set[Route]] = {}
        for r in self.find_illegal_dependencies_for_layers_df(layers, containers).collect():
            found.setdefault((r.importer, r.imported), set()).add(Route.new(r.heads, r.tails, r.middle))
        return {PackageDependency(a, b, frozenset(routes)) for (a, b), routes in found.items()}

    def _check_apart(self, levels: list[Layer], containers: Iterable[str]) -> None:
        """No layer may lie in another that it may not import, or may not be imported by."""
        placed = [(i, t, x.independent) for i, x in enumerate(levels) for t in sorted(x.module_tails)]
        nested = [(outer, inner) for i, outer, independent in placed for j, inner, _ in placed if inner.startswith(outer + ".") and (i != j or independent)]
        pairs = [tuple(f"{c}.{t}" if c else t for t in pair) for pair in nested for c in sorted(containers) or [None]]
        known = self._present(m for pair in pairs for m in pair)
        if any(known.issuperset(pair) for pair in pairs):
            raise ValueError("Modules have shared descendants.")

    def nominate_cycle_breakers_df(self, package: str) -> DataFrame:
        return cycles.cycle_breakers(self.frames, package)

    def nominate_cycle_breakers(self, package: str) -> set[tuple[str, str]]:
        """Imports without which the children of a package form no cycle."""
        self._need(package)
        return {(r.importer, r.imported) for r in self.nominate_cycle_breakers_df(package).collect()}

    # Python

    def __repr__(self) -> str:
        shown = sorted(r.name for r in self.modules_df.limit(6).collect())
        inside = ", ".join(map(repr, shown[:5])) + (", ..." if len(shown) > 5 else "") if shown else "empty"
        return f"<{type(self).__name__}: {inside}>"

    def __deepcopy__(self, memo: dict) -> ImportGraph:
        copy = type(self)(self._spark)
        copy._frames, copy._pending = self._frames, self._pending
        copy._squashed = None if self._squashed is None else dict(self._squashed)
        copy._added = tuple(dict(x) for x in self._added)
        return copy


def _names_of(df: DataFrame) -> set[str]:
    return {r[0] for r in df.collect()}


def _apart(importer: str, imported: str, as_packages: bool) -> None:
    if direct.overlap(importer, imported, as_packages):
        raise ValueError("Modules have shared descendants.")
