"""Registered queries: each graph operator over the graph of ``testgraph``, with its SQL.

Sets are returned as rows of scalars.  ``QUERIES`` has the Spark side, ``ORACLES``
the DuckDB side of those that SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom import testgraph
from edgeloom.functions import names
from edgeloom.graph import ImportGraph
from edgeloom.model import Layer
from edgeloom.operators import cycles, direct, hierarchy, layers, mutation
from edgeloom.plans.build import scan
from edgeloom.plans.frames import Frames
from edgeloom.plans.resolve import distil_external, resolve_imports
from edgeloom.sources import cache
from edgeloom.sources.discovery import module_name
from edgeloom.storage import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LEAF = "'parts.' || lower(p_type) || '.b' || replace(p_brand, 'Brand#', '') || '.p' || p_partkey"
GRAPH = f"""
m as (select p_partkey k, {LEAF} as name from part),
modules as (select name from m union select regexp_replace(name, '\\.[^.]*$', '') from m
  union select regexp_replace(name, '\\.[^.]*\\.[^.]*$', '') from m union select 'parts' from m),
edges as (select distinct ma.name importer, mb.name imported, a.l_linenumber::int line_number
  from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1
  join m ma on ma.k = a.l_partkey join m mb on mb.k = b.l_partkey
  where a.l_partkey <> b.l_partkey and round(a.l_discount * 100) = 5),
imports as (select distinct importer, imported from edges)"""

#: Packages that the queries ask about: a brand and a type.
A, B, T = "parts.promo.b13", "parts.economy", "parts.economy"


def query(sql: str | None = None, with_graph: bool = True, recursive: bool = False):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (f"with {'recursive ' if recursive else ''}{GRAPH}\n{sql}" if with_graph else sql)
        return f

    return add


def graph(spark: SparkSession, sf_dir: str) -> ImportGraph:
    return ImportGraph.of_frames(testgraph.frames(spark, sf_dir))


def written_graph(spark: SparkSession, sf_dir: str) -> ImportGraph:
    """A graph whose modules and imports are written, for queries that read them many times and its lines never."""
    f = testgraph.frames(spark, sf_dir)
    return ImportGraph.of_frames(Frames(materialize(f.modules, "modules"), materialize(f.imports, "imports"), f.details))


def one(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], list(values))


# Modules and hierarchy


@query("select name from modules")
def modules(spark, sf_dir):
    return graph(spark, sf_dir).modules_df


@query(f"select name from modules where regexp_matches(name, '^{T}\\.[^.]+$')")
def find_children(spark, sf_dir):
    return graph(spark, sf_dir).find_children_df(T)


@query(f"select name from modules where starts_with(name, '{T}.')")
def find_descendants(spark, sf_dir):
    return graph(spark, sf_dir).find_descendants_df(T)


@query("select name from modules where regexp_matches(name, '^parts\\.[^.]+\\.b1[0-9]\\.[^.]+$') and name like 'parts.%.b13.%'")
def find_matching_modules(spark, sf_dir):
    return graph(spark, sf_dir).find_matching_modules_df("parts.*.b13.**")


@query("select count(*) n from modules where name = 'parts.promo'")
def contains_module(spark, sf_dir):
    return graph(spark, sf_dir).modules_df.where(F.col("name") == "parts.promo").agg(F.count(F.lit(1)).alias("n"))


@query(f"select p.name package, x.name module from modules p join modules x on x.name = p.name or starts_with(x.name, p.name || '.') where p.name like 'parts.promo%' and p.name not like '%.p%.%.p%'")
def with_descendants(spark, sf_dir):
    known = graph(spark, sf_dir).frames.modules
    packages = known.where(names.within(F.col("name"), "parts.promo") & (names.depth(F.col("name")) <= 3)).select(F.col("name").alias("package"))
    return hierarchy.members(known, packages).select("package", "module")


@query("select name, string_split(name, '.')[1] root, nullif(regexp_extract(name, '^(.*)\\.[^.]*$', 1), '') parent, len(string_split(name, '.'))::bigint depth from modules")
def name_functions(spark, sf_dir):
    n = F.col("name")
    return graph(spark, sf_dir).modules_df.select("name", names.root(n).alias("root"), names.parent(n).alias("parent"), names.depth(n).cast("long").alias("depth"))


# Direct imports


@query("select importer, imported from imports where importer like 'parts.promo.%' and imported like 'parts.economy.%'")
def find_matching_direct_imports(spark, sf_dir):
    return graph(spark, sf_dir).find_matching_direct_imports_df("parts.promo.** -> parts.economy.**")


@query(f"select min(importer) importer, count(*) > 0 as found from imports where importer = (select min(importer) from imports) and imported = (select min(imported) from imports where importer = (select min(importer) from imports))")
def direct_import_exists(spark, sf_dir):
    g = graph(spark, sf_dir)
    e = g.frames.imports.orderBy("importer", "imported").first()
    return one(spark, importer=e.importer, found=g.direct_import_exists(importer=e.importer, imported=e.imported))


@query(f"select '{A}' importer, '{T}' imported, count(*) > 0 as found from imports where starts_with(importer, '{A}.') and starts_with(imported, '{T}.')")
def direct_import_exists_as_packages(spark, sf_dir):
    return one(spark, importer=A, imported=T, found=graph(spark, sf_dir).direct_import_exists(importer=A, imported=T, as_packages=True))


@query(f"select importer, imported from imports where starts_with(importer, '{A}.') and starts_with(imported, '{T}.')")
def direct_imports_between(spark, sf_dir):
    return direct.between(graph(spark, sf_dir).frames.imports, A, T, as_packages=True)


@query("select imported as name from imports where importer = (select min(importer) from imports)")
def directly_imported_by(spark, sf_dir):
    g = graph(spark, sf_dir)
    return g.find_modules_directly_imported_by_df(g.frames.imports.agg(F.min("importer")).first()[0])


@query("select importer as name from imports where imported = (select min(imported) from imports)")
def directly_import(spark, sf_dir):
    g = graph(spark, sf_dir)
    return g.find_modules_that_directly_import_df(g.frames.imports.agg(F.min("imported")).first()[0])


@query("select importer, imported, line_number, 'import ' || imported line_contents from edges where importer = (select min(importer) from imports) and imported = (select min(imported) from imports where importer = (select min(importer) from imports))")
def get_import_details(spark, sf_dir):
    g = graph(spark, sf_dir)
    e = g.frames.imports.orderBy("importer", "imported").first()
    return g.get_import_details_df(importer=e.importer, imported=e.imported)


@query("select count(*) n from imports")
def count_imports(spark, sf_dir):
    return graph(spark, sf_dir).frames.imports.agg(F.count(F.lit(1)).alias("n"))


# Reach and chains


def reach_sql(start: str, a: str, b: str) -> str:
    return f", r(name) as (select {b} from imports where {start.format(c=a)} union select i.{b} from imports i join r on i.{a} = r.name)\nselect name from r where not ({start.format(c='name')})"


SMALLEST = "{c} = (select min(importer) from imports)"
PACKAGE = "({c} = '" + T + "' or starts_with({c}, '" + T + ".'))"


@query(reach_sql(SMALLEST, "importer", "imported"), recursive=True)
def find_upstream(spark, sf_dir):
    g = graph(spark, sf_dir)
    return g.find_upstream_modules_df(g.frames.imports.agg(F.min("importer")).first()[0])


@query(reach_sql(PACKAGE, "importer", "imported"), recursive=True)
def find_upstream_as_package(spark, sf_dir):
    return graph(spark, sf_dir).find_upstream_modules_df(T, as_package=True)


@query(reach_sql(SMALLEST, "imported", "importer"), recursive=True)
def find_downstream(spark, sf_dir):
    g = graph(spark, sf_dir)
    return g.find_downstream_modules_df(g.frames.imports.agg(F.min("importer")).first()[0])


@query(reach_sql(PACKAGE, "imported", "importer"), recursive=True)
def find_downstream_as_package(spark, sf_dir):
    return graph(spark, sf_dir).find_downstream_modules_df(T, as_package=True)


@query(f", r(name) as (select imported from imports where starts_with(importer, '{A}.') union select i.imported from imports i join r on i.importer = r.name)\nselect count(*) > 0 as found from r where starts_with(name, '{B}.')", recursive=True)
def chain_exists(spark, sf_dir):
    return one(spark, found=graph(spark, sf_dir).chain_exists(A, B, as_packages=True))


def chain_sql(heads: str, tails: str) -> str:
    """The smallest shortest chain: distances to the tails, then the paths down them from the first head."""
    return f""", back(name, d) as (select name, 0 from modules where {tails}
  union select i.importer, b.d + 1 from imports i join back b on i.imported = b.name where b.d < 12),
dist as (select name, min(d) d from back group by name),
start as (select name, d from dist where {heads} order by d, name limit 1),
path(name, d, steps) as (select name, d, [name] from start
  union all select i.imported, p.d - 1, list_append(p.steps, i.imported) from path p join imports i on i.importer = p.name join dist t on t.name = i.imported and t.d = p.d - 1)
select array_to_string(steps, '>') chain from path where d = 0 order by steps limit 1"""


@query(chain_sql("name = (select min(importer) from imports)", "name = (select max(imported) from imports)"), recursive=True)
def shortest_chain(spark, sf_dir):
    g = graph(spark, sf_dir)
    a, b = g.frames.imports.agg(F.min("importer"), F.max("imported")).first()
    return g._chains_df(a, b, False, every=False).select(F.array_join("chain", ">").alias("chain"))


@query(chain_sql(f"starts_with(name, '{A}.')", f"starts_with(name, '{B}.')"), recursive=True)
def shortest_chain_as_packages(spark, sf_dir):
    return graph(spark, sf_dir)._chains_df(A, B, True, every=False).select(F.array_join("chain", ">").alias("chain"))


@query(f"select importer || '>' || imported chain from imports where starts_with(importer, '{A}.') and starts_with(imported, '{B}.')")
def shortest_chains_direct(spark, sf_dir):
    found = graph(spark, sf_dir).find_shortest_chains_df(A, B)
    return found.where(F.size("chain") == 2).select(F.array_join("chain", ">").alias("chain"))


@query(f"""select a.imported middle, least(count(distinct a.importer), count(distinct b.imported)) chains from imports a join imports b on a.imported = b.importer
where starts_with(a.importer, '{A}.') and starts_with(b.imported, '{B}.') and not starts_with(a.imported, '{A}.') and not starts_with(a.imported, '{B}.') group by 1""")
def shortest_chains_one_between(spark, sf_dir):
    found = graph(spark, sf_dir).find_shortest_chains_df(A, B)
    return found.where(F.size("chain") == 3).groupBy(F.element_at("chain", 2).alias("middle")).agg(F.count(F.lit(1)).alias("chains"))


@query()
def shortest_chains(spark, sf_dir):
    return graph(spark, sf_dir).find_shortest_chains_df(A, B).select(F.array_join("chain", ">").alias("chain"))


# Layers

OPEN = [Layer("economy"), Layer("large", "medium"), Layer("promo", "small", independent=False), Layer("standard")]
CLOSED = [Layer("economy"), Layer("large", closed=True), Layer("medium", "promo"), Layer("absent", closed=True), Layer("standard")]
TYPES = [Layer("economy"), Layer("large", "medium", closed=True), Layer("promo")]
BRANDS = [Layer("b11"), Layer("b12", "b13", closed=True), Layer("b21")]


def levels_sql(given: list[Layer], container: str = "parts") -> str:
    rows = [f"({i}, '{container}.{t}', {x.independent}, {x.closed})" for i, x in enumerate(given) for t in sorted(x.module_tails)]
    return f"""levels(level, module, independent, closed) as (select * from (values {', '.join(rows)})),
lay as (select * from levels where module in (select name from modules)),
pairs as (select a.module importer, b.module imported from lay a join lay b on a.module <> b.module
  where a.level > b.level or (a.level = b.level and a.independent)
  or (a.level < b.level and exists (select 1 from levels c where c.closed and c.level > a.level and c.level < b.level)))"""


def illegal_pairs(spark, sf_dir, given, container="parts"):
    levels = layers.level_rows(spark, given, [container])
    return layers.permutations(layers.present(levels, testgraph.frames(spark, sf_dir).modules)).select("importer", "imported")


@query(f", {levels_sql(OPEN)} select importer, imported from pairs")
def layers_permutations(spark, sf_dir):
    return illegal_pairs(spark, sf_dir, OPEN)


@query(f", {levels_sql(CLOSED)} select importer, imported from pairs")
def layers_closed_permutations(spark, sf_dir):
    return illegal_pairs(spark, sf_dir, CLOSED)


@query(f", {levels_sql(TYPES)} select p.importer, p.imported, i.importer head, i.imported tail from pairs p join imports i on starts_with(i.importer, p.importer || '.') and starts_with(i.imported, p.imported || '.')")
def layers_direct_routes(spark, sf_dir):
    routes = written_graph(spark, sf_dir).find_illegal_dependencies_for_layers_df(TYPES, ["parts"])
    return routes.where(F.size("middle") == 0).select("importer", "imported", F.element_at("heads", 1).alias("head"), F.element_at("tails", 1).alias("tail"))


@query(f""", {levels_sql(TYPES)} select p.importer, p.imported, a.imported middle, string_agg(distinct a.importer, ',' order by a.importer) heads, string_agg(distinct b.imported, ',' order by b.imported) tails
from pairs p join imports a on starts_with(a.importer, p.importer || '.') join imports b on b.importer = a.imported and starts_with(b.imported, p.imported || '.')
where not exists (select 1 from lay where a.imported = module or starts_with(a.imported, module || '.')) group by 1, 2, 3""")
def layers_single_middle_routes(spark, sf_dir):
    routes = written_graph(spark, sf_dir).find_illegal_dependencies_for_layers_df(TYPES, ["parts"])
    return routes.where(F.size("middle") == 1).select("importer", "imported", F.element_at("middle", 1).alias("middle"), F.array_join("heads", ",").alias("heads"), F.array_join("tails", ",").alias("tails"))


@query()
def illegal_dependencies(spark, sf_dir):
    routes = written_graph(spark, sf_dir).find_illegal_dependencies_for_layers_df(BRANDS, [T])
    return routes.select("importer", "imported", *[F.array_join(c, ",").alias(c) for c in ("heads", "middle", "tails")])


# Changes


@query(f"""select distinct case when starts_with(importer, '{T}.') then '{T}' else importer end importer, case when starts_with(imported, '{T}.') then '{T}' else imported end imported
from imports where not (starts_with(importer, '{T}.') and starts_with(imported, '{T}.'))""")
def squash_module(spark, sf_dir):
    return mutation.squash_module(testgraph.frames(spark, sf_dir), T).imports


@query(f"select name from modules where name <> '{T}' and not starts_with(name, '{T}.')")
def remove_module(spark, sf_dir):
    return mutation.remove_module(testgraph.frames(spark, sf_dir), T).modules.select("name")


@query("select importer, imported, line_number, 'import ' || imported line_contents from edges where not (importer = (select min(importer) from imports) and imported = (select min(imported) from imports where importer = (select min(importer) from imports)))")
def remove_import(spark, sf_dir):
    f = testgraph.frames(spark, sf_dir)
    e = f.imports.orderBy("importer", "imported").first()
    return mutation.remove_import(f, e.importer, e.imported).details


@query("select name, false is_squashed from modules union all select 'external', true")
def add_module(spark, sf_dir):
    return mutation.add(testgraph.frames(spark, sf_dir), modules=[("external", True), ("parts", True)]).modules


@query("select importer, imported from imports union select 'parts', 'external'")
def add_import(spark, sf_dir):
    return mutation.add(testgraph.frames(spark, sf_dir), modules=[("external", False)], imports=[("parts", "external")]).imports


# Cycles

CHILD = "'parts.' || string_split({c}, '.')[2]"


@query(f"select {CHILD.format(c='importer')} from_child, {CHILD.format(c='imported')} to_child, count(*) weight from imports where string_split(importer, '.')[2] <> string_split(imported, '.')[2] group by 1, 2")
def cycle_edge_weights(spark, sf_dir):
    return cycles.edge_weights(graph(spark, sf_dir).frames.imports, "parts")


# As all pairs of types import each other, there are no sources or sinks, and the order takes one type at a time.
@query(f""", w as (select {CHILD.format(c='importer')} a, {CHILD.format(c='imported')} b, count(*) n from imports where string_split(importer, '.')[2] <> string_split(imported, '.')[2] group by 1, 2),
kids as (select distinct 'parts.' || string_split(name, '.')[2] name from modules where name like 'parts.%'),
steps(i, taken) as (select 0, []::varchar[] union all
  select i + 1, list_append(taken, (select k.name from kids k where not list_contains(taken, k.name)
    order by coalesce((select sum(n) from w where w.a = k.name and not list_contains(taken, w.b)), 0) - coalesce((select sum(n) from w where w.b = k.name and not list_contains(taken, w.a)), 0) desc, k.name limit 1))
  from steps where i < (select count(*) from kids)),
ord as (select taken from steps order by i desc limit 1)
select importer, imported from imports, ord where string_split(importer, '.')[2] <> string_split(imported, '.')[2]
  and list_position(taken, {CHILD.format(c='imported')}) < list_position(taken, {CHILD.format(c='importer')})""", recursive=True)
def cycle_breakers(spark, sf_dir):
    return graph(spark, sf_dir).nominate_cycle_breakers_df("parts")


# Scan

SCANNED = """, s as (select importer, imported, regexp_extract(imported, 'p(\\d+)$', 1)::bigint k from imports),
t as (select importer, imported, k % 2 = 0 guarded, 'from ' || regexp_replace(imported, '\\.[^.]*$', '') || ' import p' || k as text,
  row_number() over (partition by importer order by k % 2 = 0, imported) + (k % 2 = 0)::int as line_number from s)"""


@query(f"{SCANNED} select replace(importer, '.', '/') || '.py' path, imported object_name, line_number::int line_number, text line_contents from t")
def parse_imports(spark, sf_dir):
    return scan(testgraph.sources(spark, sf_dir)[1]).select("path", "object_name", "line_number", "line_contents")


@query(f"{SCANNED} select importer, count(*) filter (where guarded) guarded, count(*) filter (where not guarded) plain from t group by 1")
def parse_type_checking(spark, sf_dir):
    found = scan(testgraph.sources(spark, sf_dir)[1])
    importer = F.replace(F.regexp_replace("path", r"\.py$", ""), F.lit("/"), F.lit("."))
    return found.groupBy(importer.alias("importer")).agg(F.count_if("typechecking_only").alias("guarded"), F.count_if(~F.col("typechecking_only")).alias("plain"))


@query(f"{SCANNED} select importer, imported, line_number::int line_number, text line_contents from t where not guarded")
def resolve_internal(spark, sf_dir):
    files, texts = testgraph.sources(spark, sf_dir)
    return resolve_imports(scan(texts), files, ["parts"], exclude_type_checking=True)


@query("""select name as module, p.up || '.x' as name, case p.dots when 0 then p.up || '.x' when 1 then regexp_replace(name, '\\.[^.]*$', '') || '.x' when 2 then regexp_replace(name, '\\.[^.]*\\.[^.]*$', '') || '.x' end absolute
from m, (values (0, 'a.b'), (1, '.'), (2, '..')) p(dots, up)""".replace("p.up || '.x' as name", "case p.dots when 0 then 'a.b.x' when 1 then '.x' else '..x' end as object_name"))
def resolve_relative(spark, sf_dir):
    leaf = testgraph.leaves(spark, sf_dir)
    rows = leaf.select(F.col("name").alias("module"), F.explode(F.array(F.lit("a.b.x"), F.lit(".x"), F.lit("..x"))).alias("object_name"))
    return rows.select("module", "object_name", names.absolute(F.col("module"), F.lit(False), F.col("object_name")).alias("absolute"))


@query("""select name, case when name in ('parts', 'parts.promo') then null when starts_with(name, 'parts.promo.b13.') or name = 'parts.promo.b13' then 'parts.promo.b13'
  when starts_with(name, 'parts.promo.') then array_to_string(string_split(name, '.')[1:3], '.') when starts_with(name, 'parts.') then array_to_string(string_split(name, '.')[1:2], '.') end external from modules""")
def distill_external(spark, sf_dir):
    return graph(spark, sf_dir).modules_df.select("name", distil_external(F.col("name"), [A]).alias("external"))


@query("select replace(name, '.', '/') || '.py' path, (k % 7)::double mtime from m where k % 3 <> 0")
def cache_misses(spark, sf_dir):
    leaf = testgraph.leaves(spark, sf_dir)
    files = leaf.select(F.concat(F.replace(F.col("name"), F.lit("."), F.lit("/")), F.lit(".py")).alias("path"), (F.col("key") % 7).cast("double").alias("mtime"), "key")
    # of the files, every third is cached as it is, the next one in an older state
    cached = files.where("key % 3 = 0").select("path", "mtime").unionAll(files.where("key % 3 = 1").select("path", F.col("mtime") - 1))
    return cache.misses(files.select("path", "mtime"), cached)


@query()
def discovered_modules(spark, sf_dir):
    """Files of this package itself, as the discovery finds them."""
    import os

    import edgeloom
    from edgeloom.sources.discovery import find_modules

    found = find_modules("edgeloom", os.path.dirname(edgeloom.__file__))
    return spark.createDataFrame([(m.module, m.is_package, module_name("edgeloom", os.path.relpath(m.path, m.directory)) == m.module) for m in found if ".llm" not in m.module], "module string, is_package boolean, named boolean")


@query()
def build_graph(spark, sf_dir):
    """The edges of this package's own graph, from its files on disk."""
    from edgeloom.plans.build import build_graph as build

    edges = build("edgeloom", include_external_packages=True, cache_dir=None, spark=spark).frames.details
    return edges.where(~F.col("importer").startswith("edgeloom.llm"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_upstream_as_package(spark, sf_dir)
