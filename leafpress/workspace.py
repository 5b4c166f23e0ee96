"""The library's front: a workspace of files, and what can be asked of it."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafpress.operators import answers
from leafpress.operators import context as C
from leafpress.ship import prepare
from leafpress.sources import readers, scan


#: Fixed value: names of read modes that are kept for later.
RESERVED_MODES = ("metadata", "outline", "range", "sheet", "slide", "page", "search")


class WorkspaceBoundaryError(ValueError):
    """A path outside the workspace."""


class Workspace:
    """Files below a root (local, or any store that Spark reads)."""

    def __init__(
        self, spark: SparkSession, root: str, *, specs: list[readers.ReaderSpec] | None = None,
        granted: Iterable[str] = ("filesystem.read",)
    ):
        self.local = "://" not in root
        if self.local:
            root = os.path.realpath(root)
            if not os.path.exists(root):
                raise FileNotFoundError(root)
            if not os.path.isdir(root):
                raise NotADirectoryError(root)
        self.spark, self.root = prepare(spark), root.rstrip("/")
        self.specs, self.granted = specs if specs is not None else readers.registry(), tuple(granted)

    def refs(self) -> DataFrame:
        claimed = self.spark.createDataFrame([(e,) for e in readers.extensions(self.specs)], "extension string")
        return scan.refs(self.files(), self.root, claimed)

    def files(self) -> DataFrame:
        """(path, name, size, modified_at) of what is listed below the root; on a local root, filters go to the listing."""
        if self.local:
            return scan.list_local(self.spark, self.root)
        return scan.list_files(self.spark, self.root)

    def resolve(self, path: str) -> str:
        """The path if it is inside; links are followed on a local root."""
        full = os.path.realpath(os.path.join(self.root, path)) if self.local else path
        if full != self.root and not full.startswith(self.root + "/"):
            raise WorkspaceBoundaryError(path)
        return full

    def artifacts(self, **options) -> DataFrame:
        """Artifacts of the files that ``refs`` lists."""
        return readers.scan(self.spark, self.root, readers=self.specs, granted=self.granted, **options)

    def read(self, path: str, mode: str = "full", **options) -> DataFrame:
        """One file's artifact; ``mode`` names how much of it, of which only all is there."""
        if mode != "full":
            raise ValueError(f"mode {mode!r} is not there; only 'full' is (the names {', '.join(RESERVED_MODES)} are kept for later)")
        return readers.scan_paths(self.spark, [self.resolve(path)], readers=self.specs, granted=self.granted, **options)

    def contexts(self, policy: C.Policy | None = None, artifacts: DataFrame | None = None) -> DataFrame:
        p = policy or C.Policy()
        rows = (self.artifacts() if artifacts is None else artifacts).where("status = 'ok'")

        def rendered(b):
            return F.struct(
                C.render(b, tables=True, max_table_rows=p.max_table_rows).alias("rendered"), b["page"].alias("page"),
                C.block_warnings(b, p.max_table_rows).alias("warnings")
            )

        prefix = len(self.root) + 2
        about = F.from_json("metadata", "struct<requires_ocr:boolean,pages:array<struct<page:int,requires_ocr:boolean>>>")
        rows = rows.withColumn("about", about).withColumns(
            {
                "requires_ocr": F.col("about.requires_ocr"),
                "ocr_pages": F.transform(
                    F.filter(
                        F.coalesce("about.pages", F.array().cast("array<struct<page:int,requires_ocr:boolean>>")),
                        lambda x: x["requires_ocr"]
                    ),
                    lambda x: x["page"]
                )
            }
        )
        return C.build(
            rows.withColumns({"blocks": F.transform("blocks", rendered), "relative_path": F.substring("path", prefix, 1 << 20)}), p,
            pages="ocr_pages"
        )

    def ask(self, question: str, model: Callable[[str, str], str], policy: C.Policy | None = None) -> DataFrame:
        return answers.ask(self.contexts(policy), question, model)
