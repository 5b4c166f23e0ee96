"""Discovery: files under a root as refs, without reading any content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafpress.functions import text as T

SYSTEM_FILES = (".ds_store", "desktop.ini", "thumbs.db")
UNFINISHED = (".tmp", ".temp", ".crdownload", ".partial")


def extension(name: str) -> str:
    """``functions.text.suffix`` for one name, without the dot."""
    stem, dot, end = name.rpartition(".")
    return end.lower() if dot and stem and not stem.endswith(".") and end else ""


def hidden(name: str) -> bool:
    """``visible`` for one name."""
    low = name.lower()
    return name.startswith((".", "~$")) or low in SYSTEM_FILES or low.endswith(UNFINISHED)


def visible(files: DataFrame) -> DataFrame:
    """Rows whose ``name`` is neither hidden nor temporary, with their ``extension`` (no dot)."""
    low = F.lower("name")
    hidden = F.startswith("name", F.lit(".")) | F.startswith("name", F.lit("~$")) | low.isin(*SYSTEM_FILES)
    for end in UNFINISHED:
        hidden |= F.endswith(low, F.lit(end))
    return files.where(~hidden).withColumn("extension", F.substring(T.suffix(F.col("name")), 2, 100))


def artifact_files(files: DataFrame, claimed: DataFrame) -> DataFrame:
    """Visible files with an extension that some provider claims; ``claimed`` is a small table of ``extension``."""
    return visible(files).where("extension <> ''").join(claimed, "extension", "left_semi")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, size, modified_at) of all files below ``root``, on any store that Spark reads.

    The content column is not selected, so no file is opened. Spark's sources pass over names that begin with
    ``_``; ``discovery.files`` keeps them, for a root that all executors see.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^file:(//)?", "")
    return files.select(
        path.alias("path"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"),
        F.col("modificationTime").alias("modified_at")
    )


def list_local(spark: SparkSession, root: str) -> DataFrame:
    """Like ``list_files`` for a root that all executors see: listed by them, names with ``_`` kept, hidden directories left out."""
    from leafpress.sources import discovery

    return discovery.files(spark, root).drop("extension")


def refs(files: DataFrame, root: str, claimed: DataFrame) -> DataFrame:
    """Refs of a workspace, in path order."""
    root = root.rstrip("/")
    if not root:
        raise ValueError("the root may not be empty")
    kept = artifact_files(files, claimed)
    return kept.select(
        T.artifact_id(F.col("path")).alias("artifact_id"), "name", "path", "extension", "size", "modified_at", F.col("extension").alias("artifact_type"), T.workspace_id(F.lit(root)).alias("workspace_id"), F.substring(F.col("path"), len(root) + 2, 1 << 20).alias("relative_path")
    ).orderBy("path")


def refs_of(paths: DataFrame, refs: DataFrame) -> DataFrame:
    """``paths`` (path) with their ref, as a left join; ``listed`` tells whether there is one. A path that is not listed may still be read."""
    known = refs.select("path", *[F.col(c) for c in refs.columns if c not in paths.columns], F.lit(True).alias("listed"))
    return paths.join(known, "path", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
