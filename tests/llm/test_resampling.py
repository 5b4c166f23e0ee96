"""Importance resampling beside brute force, and the cases of the docstring."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafpress.llm import resampling, shared

RNG = random.Random(31)
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def prose(n):
    return "".join(RNG.choice(["The", "of", "É", "日本", "x9", "AbC", "w1", "w2", "w3"]) + RNG.choice([" ", ", ", "\n"]) for _ in range(n))


def features(text, n_buckets, longest):
    own = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(own[i : i + n]) for n in range(1, longest + 1) for i in range(len(own) - n + 1)]
    return len(own), collections.Counter(zlib.crc32(r.encode()) % n_buckets for r in runs)


def brute(docs, target, n_buckets, longest, least_words, percent):
    each = [(i, *features(t, n_buckets, longest)) for i, t in docs]
    ours, aim = sum((c for *_, c in each), collections.Counter()), sum((features(t, n_buckets, longest)[1] for t in target), collections.Counter())
    size, total = sum(ours.values()) + n_buckets, sum(aim.values()) + n_buckets
    out = []
    for i, n, c in each:
        weight = sum(k * math.floor(1000 * math.log((aim[b] + 1.0) * size / ((ours[b] + 1.0) * total))) for b, k in c.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, n, sum(c.values()), weight, score, None])
    able = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = k
    return out


@pytest.mark.parametrize("n_buckets,longest,limit", [(10_000, 3, 1 << 20), (50, 2, 300), (7, 1, 40)])
def test_resample(spark, n_buckets, longest, limit):
    docs = [(k, prose(RNG.randint(0, 90))) for k in range(120)] + [(200, None), (201, ""), (202, " ., "), (203, "one"), (204, "Two words")]
    docs += [(None, prose(40)), (3, docs[3][1])]
    target = [prose(60), None, "w1 w2 w3 " * 20]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, _part string, n int").repartition(5)
    aim = spark.createDataFrame([(t, 5) for t in target], "text string, doc_id int")
    got = resampling.resample(frame, aim, n_buckets=n_buckets, longest=longest, limit=limit, least_words=10, percent=30)
    want = brute(docs, target, n_buckets, longest, 10, 30)
    drop = lambda rows: sorted(repr(list(r)[:5]) for r in rows)
    rows = got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert drop(rows) == drop(want)
    ranks = lambda rows: sorted((r[5], repr(r[0]), r[4]) for r in rows if r[5] is not None)
    assert ranks(rows) == ranks(want)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resampling.resample(empty, some).count() == 0
    (row,) = resampling.resample(some, empty).collect()
    assert row["n_features"] == 6 and row["rank"] is None


def test_pieces_of_a_long_text():
    text = (prose(3000) + "x" * 5000 + prose(50)).encode()
    (block,) = shared.blocks(pa.array([text.decode()]), 10)
    for limit in (64, 1000, 10**6):
        count, whole = resampling.Counter(97, 3), features(text.decode(), 97, 3)
        total, words = np.zeros(97, np.int64), 0
        for piece, own in resampling.pieces(block, 3, limit):
            w, c = count(np.zeros(1, np.int64), pa.array([piece.decode()]), np.array([own]))
            words += int(w["n"].sum())
            total[c["bucket"]] += c["n"]
        assert words == whole[0] and {b: n for b, n in enumerate(total.tolist()) if n} == dict(whole[1])


def test_ranks_with_many_equal_rows(spark, monkeypatch):
    """Equal rows are dealt to several ranges, none of which holds most of them."""
    made = []
    monkeypatch.setattr(resampling, "cut", lambda df: made.append(shared.cut(df)) or made[-1])
    rows = spark.range(4000).select(F.lit(7).alias("doc_id"), F.when(F.col("id") < 3600, 5).otherwise(F.col("id")).alias("score"))
    placed, n = resampling.ranked(rows)
    got = placed.select("score", "rank").collect()
    assert n == 4000 and sorted(r["rank"] for r in got) == list(range(1, 4001))
    assert all((r["score"] != 5) == (r["rank"] <= 400) for r in got)
    sizes = [r["count"] for r in made[0].groupBy("_part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000


def test_hashes_of_runs_are_made_from_their_words():
    """Words are hashed once each, and CRCs of words joined by spaces come from theirs: none, short, long and non-ASCII ones."""
    import zlib

    import pyarrow as pa

    from leafpress.llm import resampling

    words = ["", "a", "b1", "é", "日本語", "x" * 255, "y" * 256, "z" * 70_001, "word"] * 2
    before = [zlib.crc32(w.encode()) for w in words[::-1]]
    got = resampling.joined(pa.array(before, pa.uint32()), pa.array([zlib.crc32(w.encode()) for w in words], pa.uint32()), pa.array([len(w.encode()) for w in words], pa.int32()))
    assert got.to_pylist() == [zlib.crc32(f"{a} {b}".encode()) for a, b in zip(words[::-1], words, strict=True)]
