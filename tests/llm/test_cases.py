"""Hot keys, collisions of hashes, nulls and clashing names."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafpress.llm import mixing, quality, shared


def test_mix_in_groups(spark):
    """Shards in groups: the same targets, whatever the levels; null ids and clashing names do no harm."""
    rng = random.Random(8)
    rows = [(None if k % 9 == 0 else k // 2, rng.choice(["a", "a", "a", None, "b"]), "w " * rng.randint(0, 40)) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    df = df.withColumns({c: F.lit("own") for c in ("shard", "size", "target", "grp", "block", "quota", "place")}).withColumnRenamed("place", "PLACE")
    for group in (2000, 3):
        got = mixing.mix(df, shard_rows=4, group=group).collect()
        by = collections.defaultdict(lambda: [0, 0])
        for r in got:
            by[r["source"]][0] += r["taken"]
            by[r["source"]][1] = r["target"]
            assert 0 <= r["taken"] <= 3 * r["size"]
        assert len(got) == 600 and all(t == pytest.approx(want, rel=0.02, abs=10) for t, want in by.values())


def test_codes_of_windows():
    rng = np.random.default_rng(3)
    for length in range(1, 12):
        ids = rng.integers(0, 3, 200)
        got = shared.window_codes(ids, length)
        seen = {}
        want = [seen.setdefault(tuple(ids[k : k + length]), len(seen)) for k in range(len(ids) - length + 1)]
        assert len(set(zip(got.tolist(), want, strict=True))) == len(set(want)) == len(set(got.tolist()))
    assert len(shared.window_codes(np.zeros(3, np.int64), 4)) == 0


def test_quality_when_hashes_collide(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 200))) + "\n" + "x y\n" * rng.randint(0, 3) for _ in range(40)]
    block = lambda: next(shared.blocks(pa.array(texts)))
    want = quality.measure(block(), quality.Limits())
    few = lambda *a: shared.rolling(*a) & np.uint64(15)
    monkeypatch.setattr(quality, "rolling", few)
    got = quality.measure(block(), quality.Limits())
    assert all(np.array_equal(want[k], got[k]) for k in want)


def test_scratch_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError):
        shared.scratch_dir(Session())


def test_fresh_names(spark):
    df = spark.range(1).select(F.lit(1).alias("_K"), F.lit(1).alias("_k_"))
    assert shared.fresh(df, "_k", "n", "n") == ["_k__", "n", "n_"]


def test_keep_one_with_any_names(spark):
    from leafpress.llm import simhash

    df = spark.createDataFrame(
        [(None, None, 1), (None, "", 2), (3, "a b c d", 3), (3, "a b c d", 4)], "doc_id long, text string, `__key` int"
    ).withColumns({"__place": F.lit("x"), "a.b": F.lit(1)})
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    # null and empty texts share fingerprint zero; null ids come last only among others
    assert sorted((r["doc_id"], r["__key"]) for r in kept.collect() if r["doc_id"]) == [(3, 3)] and kept.count() == 2
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_hot_keys_are_split(spark):
    """Half of all rows on one key: the join with its aggregate leaves no partition over twice the mean."""
    import os

    from leafpress.llm import simhash

    saved = {}
    for k, v in {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.coalescePartitions.enabled": "false"
    }.items():
        saved[k] = spark.conf.get(k, None)
        spark.conf.set(k, v)
    try:
        n = 200_000
        rows = spark.range(0, n, 1, 16).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("a"), F.col("id").alias("b"))
        least = rows.groupBy("a").agg(F.min("b").alias("m"))
        joined = rows.join(shared.own_exchange(least, "a"), "a")
        path = f"{shared.scratch_dir(spark)}/hot_join"
        joined.write.mode("overwrite").parquet(path)
        sizes = [r["n"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(sizes) == n and max(sizes) < 2 * n / 8, sorted(sizes)[-3:]
        star = spark.range(1, 20_000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
        assert simhash.components(star).agg(F.count(F.lit(1)).alias("n"), F.max("root").alias("m")).first() == (20_000, 0)
        assert os.path.isdir(path)
    finally:
        for k, v in saved.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("bits", [64, 4])
def test_windows_are_equal_by_content(monkeypatch, bits):
    """Where hashes collide, content decides."""
    from leafpress.llm import substrings, suffixes

    rng = random.Random(bits)
    few = lambda *a: shared.rolling(*a) >> np.uint64(64 - bits)
    monkeypatch.setattr(substrings, "rolling", few)
    monkeypatch.setattr(suffixes, "rolling", few)
    for _ in range(30):
        strings = ["".join(rng.choice("ab") for _ in range(rng.randint(8, 40))) for _ in range(rng.randint(1, 9))]
        windows = [s[i : i + 8] for s in strings for i in range(len(s) - 7)]
        got = suffixes.classes(next(shared.blocks(pa.array(strings))), 8, 4, 50)
        assert len(set(zip(got.tolist(), windows, strict=True))) == len(set(windows)) == len(set(got.tolist()))
        spaced = [" ".join(s) for s in strings]
        got = substrings.classes(next(shared.blocks(pa.array(spaced))), 8)
        assert len(set(zip(got.tolist(), windows, strict=True))) == len(set(windows)) == len(set(got.tolist()))


def test_periodic_texts_are_cut():
    from leafpress.llm import superkmers

    unit = superkmers.Bytes()
    symbols, first = unit.read(next(shared.blocks(pa.array(["a" * 50_000, "ab" * 20_000]))))
    text, start, count, _, again = superkmers.super_kmers(symbols, first, 200, 24)
    assert count.max() <= superkmers.MOST_WINDOWS and again.all()
    for i, n in ((0, 50_000), (1, 40_000)):
        mine = np.sort(np.concatenate([np.arange(a, a + c) for a, c in zip(start[text == i], count[text == i], strict=True)]))
        assert np.array_equal(mine, np.arange(n - 199))


def test_decontamination_with_any_names(spark):
    from leafpress.llm import decontaminate

    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, b"x"), (1, "clean words only", b"y"), (None, None, None), (2, "word " * 60_000 + text, b"z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `__row` binary").withColumns(
        {"n_words": F.lit("own"), "__leafpress_hits": F.lit(1), "a.b": F.lit(2)}
    )
    bench = spark.createDataFrame([(5, text[:60].upper())], "item_id long, text string")
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(str(r["text"]) for r in kept.collect()) == ["None", "clean words only"]
    got = sorted((r["n_words"], r["n_hit"]) for r in decontaminate.contamination(df, bench).collect())
    n = len(text[:60].split())
    assert [x for _, x in got] == [0, 0, n - 1, n - 1] or [x for _, x in got] == [0, 0, n, n]
    assert decontaminate.drop_contaminated(df, bench.limit(0)).count() == 4


def test_stages_with_any_names_and_no_rows(spark):
    """Filters keep the columns of their input, whatever they are called, and empty tables."""
    from leafpress.llm import secrets

    df = spark.createDataFrame(
        [(1, None, 3), (2, "token=abcdefgh1", 4)], "doc_id long, text string, c0 int"
    ).withColumns({"a.b": F.lit(2), "row": F.lit(1), "Kept": F.lit(1)})
    for stage in (quality.filter_quality, secrets.redact_secrets):
        assert stage(df).columns == df.columns and stage(df.limit(0)).count() == 0
        stage(df).collect()
    assert [r["text"] for r in secrets.redact_secrets(df).orderBy("doc_id").collect()] == [None, "token=[SECRET]"]
