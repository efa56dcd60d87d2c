"""Source files of a folder as a table that executors read: the driver lists names, prunes what is excluded, and opens nothing.

Spark's own readers pass over names that begin with _ or a dot, such as `__init__.py`; these are files here like any other. Any
store that pyarrow reaches will do (a mounted folder, HDFS, S3, GCS).
"""

from __future__ import annotations

import fnmatch
import logging
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, content binary"
AT_ONCE = 32 << 20


def file_system(root: str) -> tuple[fs.FileSystem, str]:
    """The store of a root as pyarrow knows it, and the root's path there."""
    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root[5:].lstrip("/")
    if "://" not in root:
        return fs.LocalFileSystem(), root
    return fs.FileSystem.from_uri(root)


def resolved(spark: SparkSession, root: str) -> str:
    """The root where it really lies: Hadoop's names of mounts are looked up."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).resolvePath(path).toString()
    return found.rstrip("/")


def excluded(path: str, patterns: list[str]) -> bool:
    """Whether a component of the path is a pattern, or the whole path matches one; * crosses slashes."""
    return any(p in patterns for p in path.split("/")) or any(fnmatch.fnmatchcase(path, p) for p in patterns)


def listed(root: str, extensions: list[str], patterns: list[str]) -> Iterator[tuple[str, int]]:
    """(path, bytes) of the files with these extensions, in order; an excluded folder is not looked into."""
    store, base = file_system(root)
    base = base.rstrip("/")
    folders = [base]
    while folders:
        below = []
        for x in sorted(store.get_file_info(fs.FileSelector(folders.pop())), key=lambda x: x.path):
            path = x.path[len(base) + 1 :]
            if excluded(path, patterns):
                continue
            if x.type == fs.FileType.Directory:
                below.append(x.path)
            elif x.type == fs.FileType.File and path.rsplit(".", 1)[-1] in extensions:
                yield path, x.size or 0
        folders += reversed(below)


@dataclass
class Files(InputPartition):
    """Some files of the folder, that one task reads."""

    def __init__(self, paths: list[str]):
        self.paths = paths


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.size = options["root"], int(options["partitionBytes"])
        self.extensions, self.patterns = options["extensions"].split(","), [p for p in options["excludes"].split("\n") if p]

    def partitions(self) -> list[Files]:
        parts, held = [[]], 0
        for path, n in listed(self.root, self.extensions, self.patterns):
            if held and held + n > self.size:
                parts.append([])
                held = 0
            parts[-1].append(path)
            held += n + (1 << 16)  # an opened file costs more than its bytes
        return [Files(p) for p in parts]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        """Files in batches of about AT_ONCE bytes; one that cannot be read is passed over."""
        store, base = file_system(self.root)
        batch = lambda rows: pa.record_batch([pa.array([p for p, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.binary())], names=["path", "content"])
        rows, held = [], 0
        for path in partition.paths:
            try:
                with store.open_input_stream(f"{base}/{path}") as f:
                    rows.append((path, f.read()))
            except OSError as e:
                logging.getLogger(__name__).warning("not readable: %s (%s)", path, e)
                continue
            held += len(rows[-1][1])
            if held >= AT_ONCE:
                yield batch(rows)
                rows, held = [], 0
        yield batch(rows)


class SourceTree(DataSource):
    """Options: root, extensions (with commas between), excludes (a line each), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def read(spark: SparkSession, root: str, extensions: list[str], excludes: list[str]) -> DataFrame:
    """(path, content) of the files under root with one of the extensions."""
    spark.dataSource.register(SourceTree)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes").removesuffix("b")
    units = {"k": 10, "m": 20, "g": 30}
    size = int(size[:-1]) << units[size[-1]] if size[-1] in units else int(size)
    reader = spark.read.format("source_tree").option("root", resolved(spark, root)).option("partitionBytes", size)
    return reader.option("extensions", ",".join(extensions)).option("excludes", "\n".join(excludes)).load()
