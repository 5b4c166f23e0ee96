"""Discovery as a data source: directories are found level by level on executors, files are listed with pushed filters.

``directories`` runs one job a level of the tree: each task lists the directories that it is given and hands on
their subdirectories, with the number of entries of each. The table of directories is written in the shared
folder. ``spark.read.format("leafpress-files")`` then lists files: directories are packed into partitions of about
equal numbers of entries, and each partition is listed where it runs. Filters on the name's extension, on the size
and on the time of change are pushed to the source: an extension is told by the name alone, so files of others are
never asked for their size.

A file is listed if its name is neither hidden nor unfinished (``scan.hidden``); directories whose name begins with
a dot are left out, links to directories are not followed. Names with ``_``, ``=`` or ``._COPYING_`` inside are names
like any other. Files and directories that vanish or can't be read meanwhile are passed over.

The root is a path that all executors see.
"""

from __future__ import annotations

import datetime as dt
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

from leafpress import scratch
from leafpress.sources import scan

NAME = "leafpress-files"
FILES = "path string, name string, extension string, size long, modified_at timestamp"
#: Entries of directories that one partition lists, about.
ENTRIES = 50_000
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def subdirectories(path: str) -> tuple[int, list[str]]:
    """Number of entries of a directory, and its subdirectories that are listed."""
    n, found = 0, []
    try:
        with os.scandir(path) as entries:
            for e in entries:
                n += 1
                try:
                    if not e.name.startswith(".") and e.is_dir(follow_symlinks=False):
                        found.append(e.path)
                except OSError:
                    continue
    except OSError:
        return 0, []
    return n, found


def directories(spark: SparkSession, root: str) -> DataFrame:
    """(path, entries) of the root and all directories below it that are listed; a job a level, nothing walked on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                n, below = subdirectories(path)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([below], pa.list_(pa.string()))], names)

    names = ["path", "entries", "below"]
    level, levels = spark.createDataFrame([(root,)], "path string"), []
    while True:
        made = scratch.cut(level.mapInArrow(run, "path string, entries long, below array<string>"))
        levels.append(made.select("path", "entries"))
        level = made.select(F.explode("below").alias("path"))
        if level.isEmpty():
            break
        # what one directory holds is dealt to all tasks of the next level
        level = level.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


class Directories(InputPartition):
    """Directories that one task lists; ``deep``: with all below them."""

    def __init__(self, paths: list[str], deep: bool = False):
        self.paths, self.deep = paths, deep


def packed(found: list[tuple[str, int]], entries: int) -> list[list[str]]:
    """Directories (path, number of entries), in order of their paths, in parts of at most about ``entries``; a larger one is a part of its own."""
    out, size = [[]], 0
    for path, n in sorted(found):
        if out[-1] and size + n > entries:
            out.append([])
            size = 0
        out[-1].append(path)
        size += n
    return out


def partitions_of(listing: str, entries: int) -> list[Directories]:
    """The directories of a table of ``directories``, packed."""
    import pyarrow.dataset as ds

    rows = ds.dataset(listing, format="parquet").to_table(["path", "entries"]).to_pylist()
    return [Directories(p) for p in packed([(r["path"], r["entries"]) for r in rows], entries)]


#: Per kind of filter, whether a value passes.
TESTS = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v
}


class FilesReader(DataSourceReader):
    def __init__(self, root: str, listing: str, entries: int):
        self.root, self.listing, self.entries = root, listing, entries
        #: (column, kind of filter, value) that the source applies itself.
        self.pushed: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes comparisons of extension, size and modified_at with a value; Spark applies what is handed back."""
        for f in filters:
            column = getattr(f, "attribute", ())
            value = getattr(f, "value", None)
            if type(f) in TESTS and len(column) == 1 and column[0] in ("extension", "size", "modified_at") and value is not None:
                self.pushed.append((column[0], type(f), value))
            else:
                yield f

    def partitions(self) -> list[Directories]:
        return partitions_of(self.listing, self.entries)

    def passes(self, column: str, value) -> bool:
        return all(TESTS[kind](value, v) for c, kind, v in self.pushed if c == column)

    def read(self, partition: Directories):
        sized = any(c in ("size", "modified_at") for c, *_ in self.pushed)
        for path, name, size, at in files_below(partition, lambda name: self.passes("extension", scan.extension(name))):
            moment = dt.datetime.fromtimestamp(at, dt.UTC)
            if not sized or self.passes("size", size) and self.passes("modified_at", moment):
                yield path, name, scan.extension(name), size, moment


def files_below(partition: Directories, wanted: Callable[[str], bool]) -> Iterator[tuple[str, str, int, float]]:
    """``files_of`` for all directories of a partition."""
    todo = list(reversed(partition.paths))
    while todo:
        folder = todo.pop()
        yield from files_of(folder, wanted)
        if partition.deep:
            todo += subdirectories(folder)[1]


def files_of(folder: str, wanted: Callable[[str], bool]) -> Iterator[tuple[str, str, int, float]]:
    """(path, name, size, time) of the listed files in a directory whose name is ``wanted``; only these are asked for size and time."""
    try:
        with os.scandir(folder) as entries:
            for e in entries:
                try:
                    if not scan.hidden(e.name) and wanted(e.name) and e.is_file():
                        stat = e.stat()
                        yield e.path, e.name, stat.st_size, stat.st_mtime
                except OSError:
                    continue
    except OSError:
        return


class FilesSource(DataSource):
    """Options: path (the root), listing (the table of its directories), entries (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> FilesReader:
        return FilesReader(self.options["path"], self.options["listing"], int(self.options.get("entries", ENTRIES)))


def files(spark: SparkSession, root: str, *, entries: int = ENTRIES) -> DataFrame:
    """(path, name, extension, size, modified_at) of the files below a root that are listed; filters are pushed to the listing."""
    spark.dataSource.register(FilesSource)
    spark.conf.set(PUSHDOWN, "true")
    path = scratch.new_path(spark)
    directories(spark, root.rstrip("/") or "/").write.parquet(path)
    return spark.read.format(NAME).option("listing", path).option("entries", entries).load(root)


def pushed_filters(df: DataFrame) -> list[str]:
    """The filters that the source of a plan of ``files`` has taken, as the plan shows them."""
    plan = df.sparkSession.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    found = re.search(r"PushedFilters: \[(.*)\]", plan)
    return re.findall(r"\w+\([^()]*(?:\([^()]*\)[^()]*)*\)", found[1]) if found else []
