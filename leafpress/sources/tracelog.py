"""The log of reads: a sink with a commit for each task, and a compaction that keeps the last ones of each artifact.

``append`` writes traces through ``df.write.format("leafpress-traces")``. Each task writes one Parquet file under a
name that nothing reads, so a task that fails, or one that runs twice, leaves nothing behind; when all have ended the
driver renames the files of those that counted, and a failed job's are deleted. ``log`` reads what is committed.
``compact`` writes a new generation with the last ``kept`` traces of each artifact and then points to it.

The folder is a path that driver and executors see.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from leafpress.operators.runtime import TRACES_KEPT

NAME = "leafpress-traces"
FIELDS = (
    "trace_id string, artifact_id string, path string, position int, provider_id string, plugin_id string, status string, error_type string,"
    " error string, duration_ms double, started_at timestamp, fallback_from string"
)
#: Names of the pointer to the generation that counts, and of files that don't count yet.
CURRENT, PENDING = "CURRENT", ".pending-"


@dataclass
class Written(WriterCommitMessage):
    pending: str | None


class TraceWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder
        #: What begins the names of this job's files that don't count yet; made on the driver.
        self.mark = f"{PENDING}{uuid.uuid4().hex}-"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        import pyarrow.parquet as pq

        name, out = f"{self.mark}{uuid.uuid4().hex}", None
        try:
            for b in batches:
                if b.num_rows:
                    out = out or pq.ParquetWriter(f"{self.folder}/{name}", b.schema)
                    out.write_batch(b)
        except BaseException:
            if out:
                out.close()
                os.unlink(f"{self.folder}/{name}")
            raise
        if out:
            out.close()
        return Written(name if out else None)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and m.pending:
                os.rename(f"{self.folder}/{m.pending}", f"{self.folder}/{m.pending.removeprefix(PENDING)}.parquet")
        self.abort([])  # what is left is of attempts that were run twice

    def abort(self, messages: list[Written | None]) -> None:
        for name in os.listdir(self.folder):
            if name.startswith(self.mark):
                os.unlink(f"{self.folder}/{name}")


class TraceSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return FIELDS

    def writer(self, schema, overwrite: bool) -> TraceWriter:
        return TraceWriter(self.options["path"])


def generation(folder: str) -> str:
    """The part of the log's folder that counts now."""
    try:
        with open(f"{folder}/{CURRENT}", encoding="utf-8") as f:
            return f"{folder}/{f.read().strip()}"
    except FileNotFoundError:
        return f"{folder}/g0"


def append(traces: DataFrame, folder: str) -> None:
    spark = traces.sparkSession
    spark.dataSource.register(TraceSink)
    os.makedirs(generation(folder), exist_ok=True)
    kinds = StructType.fromDDL(FIELDS)
    traces.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds]).write.format(NAME).mode("append").save(generation(folder))


def log(spark: SparkSession, folder: str) -> DataFrame:
    """All committed traces."""
    now = generation(folder)
    if not os.path.isdir(now) or not any(n.endswith(".parquet") for n in os.listdir(now)):
        return spark.createDataFrame([], FIELDS)
    return spark.read.schema(FIELDS).parquet(now)


def last_of_each(traces: DataFrame, kept: int = TRACES_KEPT) -> DataFrame:
    """The newest ``kept`` traces of each artifact, once each."""
    order = W.partitionBy("artifact_id").orderBy(F.col("started_at").desc(), F.col("position").desc(), "trace_id")
    return traces.dropDuplicates(["trace_id"]).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= kept).drop("_n")


def compact(spark: SparkSession, folder: str, kept: int = TRACES_KEPT) -> None:
    """A new generation of the log; readers see the old one until it is whole. No append may run meanwhile."""
    new = f"g{uuid.uuid4().hex}"
    last_of_each(log(spark, folder), kept).write.parquet(f"{folder}/{new}")
    with open(f"{folder}/{CURRENT}.new", "w", encoding="utf-8") as f:
        f.write(new)
    os.replace(f"{folder}/{CURRENT}.new", f"{folder}/{CURRENT}")
