"""Let Python workers import this package where it is used from a checkout, or only the driver has it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def prepare(spark: SparkSession) -> SparkSession:
    """Workers that see this checkout's folder import from it."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to executors that don't have it; once a session, before the first query.

    Executors fetch the archive when their first task starts, so it stays on the driver's disk until the driver ends.
    """
    folder = tempfile.mkdtemp(prefix="leafpress-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/leafpress", "zip", ROOT, "leafpress"))
