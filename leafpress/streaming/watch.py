"""Files of a watched folder through the same readers, as a stream without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafpress.sources import readers

BINARY = "path string, modificationTime timestamp, length long, content binary"


def artifacts(spark: SparkSession, root: str, **options) -> DataFrame:
    """New files below ``root`` as they come; write it in append mode with a checkpoint.

    The size limit is a filter, so of larger files no content is read.
    """
    files = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").load(root)
    return readers.within_limit(files, **options)
