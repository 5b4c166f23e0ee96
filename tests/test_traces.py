"""Reads in stages, the traces that they leave, and the log's commits."""

import dataclasses
import os

import pytest
from pyspark.sql import functions as F

from leafpress.sources import readers as R
from leafpress.sources import tracelog


def made():
    """Readers, as closures that workers get by value."""

    def odd(data):
        if len(data) % 2:
            raise ValueError("odd")
        return R.read_text(data)

    def never(data):
        raise ValueError("never")

    return [
        R.ReaderSpec("picky.read", ("txt", "log"), odd, priority=200), R.ReaderSpec("never.read", ("log",), never, priority=300),
        *[s for s in R.defaults() if s.provider_id != "text.read"], R.ReaderSpec("text.read", ("txt",), R.read_text, priority=50),
        R.ReaderSpec("net.read", ("net",), R.read_text, required=("network",)), R.ReaderSpec("late.read", ("net",), R.read_text, priority=1)
    ]


SPECS = made()


def files(spark):
    names = [f"/w/{k}.{e}" for k, e in enumerate(["txt", "txt", "log", "log", "zip", "doc", "net", "txt", "docx"])]
    rows = [(n, None if k == 7 else b"x" * (k * 3 + 4)) for k, n in enumerate(names)]
    return spark.createDataFrame(rows, "path string, content binary")


def test_stages_read_like_chains(spark):
    fields = ["path", "provider_id", "fallback_from", "status", "error_type", "content", "n_blocks", "line_count"]

    def seen(df):
        tried = F.transform("attempts", lambda x: F.concat_ws("/", x["provider_id"], x["status"], x["error_type"], x["fallback_from"]))
        return sorted(map(tuple, df.select(*fields, F.array_join(tried, " ")).collect()), key=repr)

    got, want = seen(R.read_staged(files(spark), readers=SPECS, max_bytes=1000)), seen(R.read(files(spark), readers=SPECS, max_bytes=1000))
    assert got == want and len(got) == 9


def test_files_that_succeed_are_read_once(spark, tmp_path):
    def counted(name, read):
        def run(data):
            with open(tmp_path / "calls", "a") as f:
                f.write(f"{name}:{len(data)}\n")
            return read(data)

        return run

    specs = [dataclasses.replace(s, read=counted(s.provider_id, s.read)) for s in SPECS]
    R.read_staged(files(spark), readers=specs).count()
    calls = (tmp_path / "calls").read_text().split()
    assert len(calls) == len(set(calls)) and "text.read:4" not in calls and "text.read:7" in calls


def test_traces_are_written_by_reads(spark, tmp_path):
    folder = str(tmp_path)
    assert tracelog.log(spark, folder).count() == 0
    read = R.read(files(spark), readers=SPECS).cache()
    tracelog.append(R.traces(read), folder)
    got = {(r["path"], r["position"]): r for r in tracelog.log(spark, folder).collect()}
    assert got["/w/1.txt", 0]["error_type"] == "ArtifactParseError" and got["/w/1.txt", 1]["fallback_from"] == "picky.read"
    assert got["/w/1.txt", 1]["status"] == "ok" and ("/w/4.zip", 0) not in got and got["/w/6.net", 0]["error_type"] == "PluginPermissionError"
    tracelog.append(R.traces(read), folder)  # the same once more: compaction keeps each once
    again = R.read(files(spark), readers=SPECS)
    tracelog.append(R.traces(again), folder)
    assert tracelog.log(spark, folder).count() == 3 * len(got)
    tracelog.compact(spark, folder, kept=2)
    kept = tracelog.log(spark, folder).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("started_at").alias("first")).collect()
    assert {r["n"] for r in kept} == {1, 2} or {r["n"] for r in kept} == {2}
    tracelog.append(R.traces(again), folder)
    assert tracelog.log(spark, folder).count() == sum(r["n"] for r in kept) + len(got)


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path)
    some = spark.range(0, 100, 1, 4).select(
        F.col("id").cast("string").alias("trace_id"),
        F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.lit("a")).alias("artifact_id"), F.lit("p").alias("path"),
        F.lit(0).alias("position"), *[F.lit(None).cast("string").alias(c) for c in ("provider_id", "plugin_id", "status", "error_type", "error")],
        F.lit(1.0).alias("duration_ms"), F.current_timestamp().alias("started_at"), F.lit(None).cast("string").alias("fallback_from")
    )
    with pytest.raises(Exception, match="lost"):
        tracelog.append(some, folder)
    assert tracelog.log(spark, folder).count() == 0
    assert not [n for n in os.listdir(tracelog.generation(folder)) if not n.startswith(tracelog.PENDING)]
    tracelog.append(some.where("trace_id <> '77'"), folder)
    assert tracelog.log(spark, folder).count() == 99


def test_only_the_job_s_own_files_go(tmp_path):
    mine, other = tracelog.TraceWriter(str(tmp_path)), tracelog.TraceWriter(str(tmp_path))
    for w in (mine, mine, other):
        (tmp_path / f"{w.mark}{len(os.listdir(tmp_path))}").write_text("x")
    mine.commit([tracelog.Written(f"{mine.mark}0"), None])
    left = sorted(os.listdir(tmp_path))
    assert len(left) == 2 and left[0].startswith(other.mark) and left[1].endswith("-0.parquet")
