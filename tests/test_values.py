"""Doubles as text beside Python's own formatting."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafpress.functions import values as V

CASES = [
    0.0, -0.0, math.inf, -math.inf, math.nan, 1e38, 1e300, -1e300, 5e-324, 2.5e-323, 1e22, 1e23, 123456.5, 0.1234565, 1234565.0, 999999.5,
    99999.95, 0.0001, 0.00009999995, 1e-310, V.NORMAL, 2.0**53, 2.0**1023, 1.7976931348623157e308, 0.5, 2.5, 100000.5, 1e5, 1e6, 123456.7
]


def written(x):
    return str(int(x)) if math.isfinite(x) and x.is_integer() else format(x, "g")


@pytest.mark.parametrize("seed", range(2))
def test_numbers(spark, seed):
    rng = np.random.default_rng(seed)
    xs = CASES + rng.integers(-(2**63), 2**63 - 1, 6000, dtype=np.int64).view(np.float64).tolist()
    xs += rng.uniform(-1e7, 1e7, 3000).tolist() + [round(x, 2) for x in rng.uniform(0, 1e5, 3000).tolist()]
    xs += [m * 2.0**-1074 for m in rng.integers(1, 2**40, 300).tolist()]
    df = spark.createDataFrame(pa.table({"x": pa.array(xs, pa.float64())}))
    got = df.select("x", V.number(F.col("x")).alias("text"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(x["x"], x["text"], written(x["x"])) for x in got.toArrow().to_pylist() if x["text"] != written(x["x"])] == []


def test_nulls_and_kinds(spark):
    row = spark.sql("select cast(null as double) x, 7 n, 2.50 d").select(*[V.number(F.col(c)) for c in ("x", "n", "d")]).first()
    assert tuple(row) == ("", "7", "2.5")
