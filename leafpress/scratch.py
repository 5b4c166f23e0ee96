"""Tables that a plan writes and reads again, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset and the master is local."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="leafpress-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession) -> str:
    return f"{folder(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame, mode: str = "parquet") -> DataFrame:
    """``df`` written and read back: its lineage ends here, and a lost executor takes nothing with it."""
    spark, path = df.sparkSession, new_path(df.sparkSession)
    df.write.format(mode).save(path)
    return spark.read.format(mode).schema(df.schema).load(path)


def local_path(path: str) -> str | None:
    """The path of a file URI or plain path; None for other stores."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


def release(spark: SparkSession) -> None:
    """Delete this application's tables, once no result that reads them is needed any more."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder(spark))
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)
