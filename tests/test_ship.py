"""The package reaches executors that don't have it."""

import importlib.util
import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").getOrCreate()
from leafpress.ship import ship
ship(spark)
def run(batches):
    import leafpress, pyarrow as pa
    from leafpress.functions import text
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([leafpress.__file__] * b.num_rows)], ["at"])
print("AT", {{r["at"] for r in spark.range(3).mapInArrow(run, "at string").collect()}})
"""


def test_ship_to_a_cluster(tmp_path):
    root = str(Path(__file__).resolve().parents[1])
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():  # executors write to a folder in Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    env |= {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=150)
    assert "leafpress.zip" in done.stdout, done.stdout + done.stderr[-2000:]
