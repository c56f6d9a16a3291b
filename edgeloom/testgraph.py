"""A graph of dotted names derived from the ``part`` and ``lineitem`` tables.

Leaves are parts, under their type and brand; a leaf imports the part on the next
line of the same order, where the line's discount is 5 %.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions import names
from edgeloom.plans.frames import Frames


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.concat(F.lit("parts."), F.lower("p_type"), F.lit(".b"), F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")), F.lit(".p"), F.col("p_partkey").cast("string"))
    return part.select(F.col("p_partkey").alias("key"), name.alias("name"))


def frames(spark: SparkSession, sf_dir: str) -> Frames:
    leaf = leaves(spark, sf_dir)
    modules = leaf.select(F.explode(names.self_and_ancestors(F.col("name"))).alias("name")).distinct().withColumn("is_squashed", F.lit(False))
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")
    a = line.where("round(l_discount * 100) = 5").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("a"))
    b = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("b"))
    # merged: each of these sides grows with the tables, and a broadcast would pass through the driver
    met = a.hint("merge").join(b, ["l_orderkey", "l_linenumber"]).where("a <> b")
    met = met.join(leaf.select(F.col("key").alias("a"), F.col("name").alias("importer")).hint("merge"), "a").join(leaf.select(F.col("key").alias("b"), F.col("name").alias("imported")).hint("merge"), "b")
    details = met.select("importer", "imported", F.col("l_linenumber").cast("int").alias("line_number"), F.concat(F.lit("import "), "imported").alias("line_contents")).distinct()
    return Frames(modules, met.select("importer", "imported").distinct(), details)


def sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(files, sources): a Python file for each leaf that imports, its imports in order of name, those of even keys under a guard."""
    edges = frames(spark, sf_dir).imports
    key = F.regexp_extract("imported", r"p(\d+)$", 1).cast("long")
    text = F.concat(F.lit("from "), names.parent(F.col("imported")), F.lit(" import p"), key.cast("string"))
    row = F.struct((key % 2 == 0).cast("int").alias("guarded"), F.col("imported"), text.alias("text"))
    lines = edges.groupBy("importer").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    plain, guarded = "transform(filter(rows, r -> r.guarded = 0), r -> r.text)", "transform(filter(rows, r -> r.guarded = 1), r -> '    ' || r.text)"
    body = F.expr(f"array_join(concat({plain}, if(exists(rows, r -> r.guarded = 1), array('if TYPE_CHECKING:'), array()), {guarded}), '\n')")
    path = F.concat(F.replace(F.col("importer"), F.lit("."), F.lit("/")), F.lit(".py"))
    texts = lines.select(path.alias("path"), body.alias("content"))
    path = F.concat(F.replace(F.col("name"), F.lit("."), F.lit("/")), F.lit(".py"))
    modules = frames(spark, sf_dir).modules
    files = modules.select(F.lit("parts").alias("package"), F.lit("").alias("directory"), F.col("name").alias("module"), path.alias("path"), F.lit(False).alias("is_package"), F.lit(0.0).alias("mtime"))
    return files, texts
