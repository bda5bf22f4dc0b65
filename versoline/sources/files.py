"""A data source for file trees: every entry with its kind, exec bit and bytes.

Spark's own file sources skip empty files and hidden names and follow links silently; this one reports all
of them. Entries of roots and of the directories there are dealt to partitions, so large trees are read in parallel. Filters on
paths that Spark hands over are tried before an entry is opened.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

SCHEMA = "root string, path string, is_dir boolean, is_symlink boolean, is_file boolean, is_exec boolean, content binary"


#: Partitions at least, where there are as many entries, and entries that another partition is worth.
PARTITIONS, ENTRIES = 4, 64


class Entries(InputPartition):
    """Entries (root, path, below): with all below them, or alone."""

    def __init__(self, entries: list[tuple[str, str, bool]]):
        super().__init__(None)
        self.entries = entries


#: How filters on paths that Spark can hand over are tried.
TESTS = {EqualTo: str.__eq__, In: lambda path, values: path in values, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: str.__contains__}


def row(root: str, path: str) -> tuple:
    """What an entry is. The exec bit and is_file are those of a link's target, as a shell's tests see them."""
    full = os.path.join(root, path)
    link = stat.S_ISLNK(os.lstat(full).st_mode)
    try:
        mode = os.stat(full).st_mode
    except OSError:  # a link to nothing
        return root, path, False, link, False, False, None
    regular = stat.S_ISREG(mode)
    content = None
    if regular:
        with open(full, "rb") as f:
            content = f.read()
    return root, path, stat.S_ISDIR(mode), link, regular, bool(mode & 0o111) and regular, content


class FilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [p for p in options.get("path", "").split(",") if p]
        self.content = options.get("content", "true").lower() == "true"
        if not self.roots:
            raise ValueError("the files source needs a path")
        self.tests: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on paths are kept; all of them are left to Spark too, which costs little next to reading files."""
        for f in filters:
            if type(f) in TESTS and f.attribute == ("path",):
                self.tests.append((type(f), f.value))
            yield f

    def wanted(self, path: str) -> bool:
        return all(TESTS[kind](path, value) for kind, value in self.tests)

    def partitions(self) -> list[Entries]:
        out = []
        for root in self.roots:
            if os.path.isdir(root):
                for name in sorted(os.listdir(root)):
                    full = os.path.join(root, name)
                    inner = sorted(os.listdir(full)) if os.path.isdir(full) and not os.path.islink(full) else []
                    out += [(root, name, not inner), *((root, f"{name}/{x}", True) for x in inner)]
        parts = max(min(len(out), PARTITIONS), len(out) // ENTRIES, 1)
        return [Entries(out[k::parts]) for k in range(parts)]

    def read(self, partition: Entries) -> Iterator[tuple]:
        work = partition.entries[::-1]
        while work:
            root, path, below = work.pop()
            full = os.path.join(root, path)
            if self.wanted(path):
                found = row(root, path)
                yield found if self.content else (*found[:-1], None)
            if below and os.path.isdir(full) and not os.path.islink(full):  # links to directories aren't entered
                work += [(root, f"{path}/{x}", True) for x in sorted(os.listdir(full), reverse=True)]


class FilesDataSource(DataSource):
    """spark.read.format("files").load("/a,/b"): rows for all entries below the roots; a missing root has none."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FilesReader:
        return FilesReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets Spark hand filters to sources like it, without which it refuses to read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FilesDataSource)


def read_files(spark: SparkSession, *roots: str) -> DataFrame:
    register(spark)
    return spark.read.format("files").load(",".join(roots))
