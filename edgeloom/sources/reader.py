"""A Spark data source of source files.

Spark's own file readers take names with a leading underscore for hidden, and
with them every ``__init__.py``; so this source is given the paths.  They are
dealt in chunks, read and decoded where they land.
"""

from __future__ import annotations

import codecs
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The encoding comment of a source file's first two lines (a fixed pattern of the language).
COOKIE = re.compile(rb"^[ \t\f]*#.*?coding[:=][ \t]*([-\w.]+)")
SCHEMA = "path string, content string, error string"


def decode(data: bytes) -> str:
    """UTF-8, or the encoding that one of the first two lines names."""
    name = next((m[1].decode() for line in re.split(rb"\r\n|\r|\n", data)[:2] if (m := COOKIE.match(line))), None)
    if name is None:
        return data.decode("utf-8-sig")
    return data.decode(codecs.lookup(name).name)


class Chunk(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class SourceReader(DataSourceReader):
    def __init__(self, paths: list[str], chunk: int):
        self.paths, self.chunk = paths, chunk

    def partitions(self):
        return [Chunk(self.paths[i : i + self.chunk]) for i in range(0, len(self.paths), self.chunk)] or [Chunk([])]

    def read(self, partition):
        for path in partition.paths:
            try:
                with open(path, "rb") as f:
                    yield path, decode(f.read()), None
            except (OSError, UnicodeDecodeError, LookupError) as e:
                yield path, None, f"{type(e).__name__}: {e}"


class PythonSources(DataSource):
    """Options: ``paths`` (a JSON list) and ``chunk`` (files a task)."""

    @classmethod
    def name(cls):
        return "python_sources"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return SourceReader(json.loads(self.options["paths"]), int(self.options.get("chunk", "64")))


def read_sources(spark: SparkSession, paths: list[str], chunk: int = 64) -> DataFrame:
    spark.dataSource.register(PythonSources)
    return spark.read.format("python_sources").option("paths", json.dumps(paths)).option("chunk", chunk).load()
