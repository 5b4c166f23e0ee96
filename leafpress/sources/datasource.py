"""``spark.read.format("leafpress").load(root)``: files of a folder that all executors see, as artifacts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In

from leafpress import scratch
from leafpress.sources import discovery, readers, scan

OUT = "path string, name string, artifact_type string, title string, content string, n_blocks int, provider_id string, fallback_from string, status string, error_type string, error string"


class ArtifactReader(DataSourceReader):
    """Reads directories side by side: those of a listing, or else each directory in the root with all below it."""

    def __init__(self, root: str, listing: str | None, entries: int, max_bytes: int):
        self.root, self.listing, self.entries, self.max_bytes = root, listing, entries, max_bytes
        self.wanted = frozenset(readers.extensions())

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes the artifact type, which a name tells: files of other types are not opened."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("artifact_type",):
                self.wanted &= {f.value} if isinstance(f, EqualTo) else set(f.value)
            else:
                yield f

    def partitions(self) -> list[discovery.Directories]:
        if self.listing:
            return discovery.partitions_of(self.listing, self.entries)
        return [discovery.Directories([self.root])] + [discovery.Directories([p], deep=True) for p in discovery.subdirectories(self.root)[1]]

    def read(self, partition: discovery.Directories):
        specs = readers.registry()
        for path, name, size, _ in discovery.files_below(partition, lambda name: scan.extension(name) in self.wanted):
            ext = scan.extension(name)
            if size > self.max_bytes:
                made = readers.too_large(self.max_bytes)
            else:
                try:
                    with open(path, "rb") as f:
                        data = f.read()
                except OSError:  # it has gone meanwhile
                    continue
                made = readers.attempt(readers.chain(ext, specs), frozenset(["filesystem.read"]), data, readers.refusal(ext, specs))
            yield path, name, ext, made.get("title") or name.rpartition(".")[0], made.get("content"), len(made.get("blocks", [])), made.get("provider_id"), made.get("fallback_from"), made["status"], made["error_type"], made["error"]


class ArtifactSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "leafpress"

    def schema(self) -> str:
        return OUT

    def reader(self, schema) -> ArtifactReader:
        entries, limit = self.options.get("entries", discovery.ENTRIES), self.options.get("maxBytes", readers.MAX_BYTES)
        return ArtifactReader(self.options["path"], self.options.get("listing"), int(entries), int(limit))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArtifactSource)
    spark.conf.set(discovery.PUSHDOWN, "true")


def load(spark: SparkSession, root: str, *, entries: int = discovery.ENTRIES, **options) -> DataFrame:
    """The source over directories that executors have listed, packed into partitions of about equal numbers of entries."""
    register(spark)
    path = scratch.new_path(spark)
    discovery.directories(spark, root.rstrip("/") or "/").write.parquet(path)
    return spark.read.format(ArtifactSource.name()).options(listing=path, entries=entries, **options).load(root)
