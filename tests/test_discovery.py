"""One listing for refs, artifacts and sources, made by executors, with filters pushed to it."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from leafpress.sources import datasource, discovery, readers
from leafpress.workspace import Workspace

NAMES = [
    "a.txt", "_b.txt", "_a=1.txt", "_metadata.txt", "k=v/c.csv", "_under/deep/d.md", "x._COPYING_/e.log", "f._COPYING_", "g.bin", "sub/big.txt",
    ".git/h.txt", "~$i.txt", "j.tmp", "sub/.k.txt"
]
LISTED = ["_a=1.txt", "_b.txt", "_metadata.txt", "_under/deep/d.md", "a.txt", "k=v/c.csv", "sub/big.txt", "x._COPYING_/e.log"]


@pytest.fixture
def tree(tmp_path):
    for name in NAMES:
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x" * 500 if "big" in name else "y")
    os.utime(tmp_path / "root/a.txt", (1_000_000_000, 1_000_000_000))
    (tmp_path / "root/loop").symlink_to(tmp_path / "root")
    return str(tmp_path / "root")


def below(df, root):
    return sorted(r["path"][len(root) + 1 :] for r in df.collect())


def test_one_listing(spark, tree):
    ws = Workspace(spark, tree)
    artifacts = ws.artifacts()
    assert below(artifacts, ws.root) == below(ws.refs(), ws.root) == LISTED
    assert {r["status"] for r in artifacts.select("status").collect()} == {"ok"}
    datasource.register(spark)
    assert below(spark.read.format("leafpress").load(ws.root), ws.root) == LISTED
    assert below(datasource.load(spark, ws.root, entries=2), ws.root) == LISTED


def test_filters_are_pushed(spark, tree):
    files = discovery.files(spark, tree, entries=3)
    assert files.rdd.getNumPartitions() > 1
    some = files.where((F.col("extension") == "txt") & (F.col("size") < 100) & F.col("name").contains("b"))
    assert below(some, tree) == ["_b.txt"]
    pushed = " ".join(discovery.pushed_filters(some))
    assert "extension" in pushed and "size" in pushed and "name" not in pushed
    old = files.where(F.col("modified_at") < F.lit(dt.datetime(2010, 1, 1, tzinfo=dt.UTC)))
    assert below(old, tree) == ["a.txt"] and "modified_at" in " ".join(discovery.pushed_filters(old))
    assert below(files.where(F.col("extension").isin("md", "log")), tree) == ["_under/deep/d.md", "x._COPYING_/e.log"]


def test_other_types_are_not_asked_for_their_size(monkeypatch):
    class Entry:
        def __init__(self, name):
            self.name, self.path = name, f"/r/{name}"

        def is_file(self):
            return True

        def stat(self):
            assert self.name == "a.txt"
            return os.stat_result((0,) * 6 + (7, 0, 0, 0))

    class Entries(list):
        __enter__, __exit__ = (lambda self: self), (lambda *a: None)

    monkeypatch.setattr(os, "scandir", lambda path: Entries([Entry("a.txt"), Entry("b.bin")]))
    reader = discovery.FilesReader("/r", "", 1)
    filters = [discovery.EqualTo(("extension",), "txt"), discovery.GreaterThan(("size",), 5), discovery.EqualTo(("name",), "b")]
    assert list(reader.pushFilters(filters)) == filters[2:]
    assert [r[1] for r in reader.read(discovery.Directories(["/r"]))] == ["a.txt"]


def test_artifact_type_is_pushed(spark, tree):
    datasource.register(spark)
    some = spark.read.format("leafpress").load(tree).where("artifact_type = 'md'")
    assert below(some, tree) == ["_under/deep/d.md"]


def test_packing():
    assert discovery.packed([("a", 5), ("b", 9), ("c", 1), ("d", 1)], 6) == [["a"], ["b"], ["c", "d"]]
    assert discovery.packed([], 6) == [[]]


def test_what_is_not_there(spark, tmp_path):
    assert discovery.files(spark, str(tmp_path)).count() == 0
    assert discovery.directories(spark, str(tmp_path / "none")).collect()[0]["entries"] == 0
    gone = spark.createDataFrame([(str(tmp_path / "gone.txt"), 3)], "path string, size long")
    assert readers.read_listed(gone).count() == 0
    assert list(discovery.files_of(str(tmp_path / "none"), lambda name: True)) == []
