"""Cached scans: raw imports by file and modification time.

What is kept is the parse, not the resolved edges: resolving is a join and runs
every time, so a module that comes or goes is noticed by files that haven't
changed, and one cache serves all options.
"""

from __future__ import annotations

import hashlib
import logging
import os
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

logger = logging.getLogger(__name__)
DEFAULT_DIR = ".edgeloom_cache"
SCHEMA = "path string, mtime double, object_name string, line_number int, line_contents string, typechecking_only boolean"
COLUMNS = ["path", "mtime", "object_name", "line_number", "line_contents", "typechecking_only"]


def cache_name(packages: list[str]) -> str:
    """A name of bounded length for a set of packages."""
    return hashlib.blake2b(",".join(sorted(packages)).encode(), digest_size=20).hexdigest()


def _current(folder: str) -> str | None:
    try:
        with open(os.path.join(folder, "current")) as f:
            return os.path.join(folder, f.read().strip())
    except OSError:
        return None


def read(spark: SparkSession, cache_dir: str, packages: list[str]) -> DataFrame:
    """The cached rows; none where there is no cache or it can't be read.  A file without imports has a row without a name."""
    path = _current(os.path.join(cache_dir, cache_name(packages)))
    if path:
        try:
            found = pq.read_table(path)
            if found.column_names == COLUMNS:
                return spark.createDataFrame(found, SCHEMA)
        except (pa.ArrowException, OSError) as e:
            logger.warning("could not use the cache at %s: %s", path, type(e).__name__)
    return spark.createDataFrame([], SCHEMA)


def write(rows: DataFrame, cache_dir: str, packages: list[str]) -> None:
    """Write a new version beside the old one, then point to it, so readers never see half of one.

    The folder is the driver's own, as the packages are, so the driver writes:
    a row for each import statement of the packages.
    """
    folder = os.path.join(cache_dir, cache_name(packages))
    os.makedirs(folder, exist_ok=True)
    # the signature is a fixed value of the cache folder convention
    markers = {".gitignore": "*\n", "CACHEDIR.TAG": "Signature: 8a477f597d28d172789f06886806bc55\n"}
    for name, text in markers.items():
        if not os.path.exists(path := os.path.join(cache_dir, name)):
            with open(path, "w") as f:
                f.write(text)
    version = f"{uuid.uuid4().hex}.parquet"
    pq.write_table(rows.select(*COLUMNS).toArrow(), os.path.join(folder, version))
    old = _current(folder)
    with open(os.path.join(folder, "current.new"), "w") as f:
        f.write(version)
    os.replace(os.path.join(folder, "current.new"), os.path.join(folder, "current"))
    if old and os.path.exists(old):
        os.remove(old)


def misses(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files that the cache lacks at their present modification time."""
    known = cached.select("path", "mtime").distinct()
    return files.join(known, ["path", "mtime"], "left_anti")


def hits(files: DataFrame, cached: DataFrame) -> DataFrame:
    return cached.join(files.select("path", "mtime"), ["path", "mtime"], "left_semi").select(*[F.col(c) for c in COLUMNS])
