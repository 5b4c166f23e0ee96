"""Importance resampling towards a target: hashed n-gram counts by DuckDB in each task, merged and scored by Spark.

``counted`` gives each task's texts to a DuckDB of its own, in blocks: SQL extracts words, unnests them, windows
them to runs of 1 to ``longest`` words, hashes these by a registered function (zlib's CRC-32) to buckets, and counts
buckets a text. The counts are written as Parquet in the shared folder, where Spark merges them to totals
(``totals``: at most as many rows as there are buckets) and scores each text from its own counts (``scored``).

``ranked`` numbers rows in a global order without one task for all: rows are range-partitioned by that order and a
row id (so equal rows can be split), each range numbers its own, and the sizes of the ranges before are added.

Memory: a block holds ``BLOCK`` bytes of texts; a longer text is cut between words into pieces of that size, each
with the words that its last runs need, and the counts of its pieces are added up. DuckDB has a limit of
``MEMORY`` and no folder to spill to.

Cases: null, empty and wordless texts have no features and weight 0; a null doc_id is hashed as an empty one and
comes last among equal scores; rows with equal ids, and repeated rows, are rows of their own, each counted and
drawn; an empty table gives an empty result; an empty target makes all its counts 0; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafpress.llm.shared import Runs, Texts, blocks, byte_set, cut, partitions, table

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
#: Of a hundred texts with ``LEAST_WORDS`` words or more, so many are drawn.
PERCENT = 5
SEED = 42
BLOCK = 1 << 19
MEMORY = "256MB"
#: Rows of counts that one numpy pass holds at once, and half the rows of texts.
ROWS = 500
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-case.
WORD_BYTES = byte_set(bytes([*b"0123456789", *UPPER.encode(), *LOWER.encode(), *range(128, 256)]))


def crc(strings: pa.Array) -> pa.Array:
    """The CRC-32 of each string's UTF-8 bytes."""
    if isinstance(strings, pa.ChunkedArray):
        strings = strings.combine_chunks()
    strings = strings.cast(pa.large_binary())
    ends = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1].tolist()
    data, of = memoryview(strings.buffers()[2] or b""), zlib.crc32
    return pa.array([of(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.uint32())


def zeros_tables() -> np.ndarray:
    """[i, j, x]: what 2 ** i zero bytes make of a CRC-32 register whose byte j is x and whose others are 0."""
    table = np.array([zlib.crc32(bytes([x])) for x in range(256)], np.uint32)
    table ^= table[0]  # without the conditioning before and after
    own = np.arange(256, dtype=np.uint32)
    step = np.stack([own << np.uint32(8 * j) for j in range(4)])
    step = (step >> np.uint32(8)) ^ table[step & np.uint32(255)]  # one zero byte
    out = []
    for _ in range(LENGTH_BITS):
        out.append(step)
        step = shifted(step, step)
    return np.stack(out)


def shifted(register: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = table[0][register & np.uint32(255)]
    for j in range(1, 4):
        out = out ^ table[j][register >> np.uint32(8 * j) & np.uint32(255)]
    return out


#: Bits of a word's length in bytes.
LENGTH_BITS = 31
ZEROS: list[np.ndarray] = []


def joined(before: pa.Array, word: pa.Array, size: pa.Array) -> pa.Array:
    """The CRC-32 of a string, a space and a word from the string's CRC, the word's CRC and its size in bytes."""
    if not ZEROS:
        ZEROS.append(zeros_tables())
    b, w, n = (np.asarray(x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x) for x in (before, word, size))
    out = shifted(b, ZEROS[0][0]) ^ np.uint32(zlib.crc32(b" "))
    for bit in range(int(n.max(initial=0)).bit_length()):
        at = np.flatnonzero(n >> bit & 1)
        out[at] = shifted(out[at], ZEROS[0][bit])
    return pa.array(out ^ w)


class Counter:
    """A DuckDB that counts hashed runs of words.

    A word is hashed once, and the runs' hashes are made from their words' ones (``joined``), so no run is ever a string.
    """

    def __init__(self, n_buckets: int, longest: int):
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        self.con.create_function("crc", crc, ["VARCHAR"], "UINTEGER", type="arrow")
        self.con.create_function("joined", joined, ["UINTEGER", "UINTEGER", "INTEGER"], "UINTEGER", type="arrow")
        after = "".join(f", lead(c0, {k}) OVER p AS c{k}, lead(z0, {k}) OVER p AS z{k}" for k in range(1, longest))
        runs = ["c0"]
        for k in range(1, longest):
            runs.append(f"joined({runs[-1]}, c{k}, z{k})")
        self.split = rf"""
            CREATE OR REPLACE TEMP TABLE split AS
            SELECT "row", piece, own, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM pieces"""
        self.words = 'SELECT "row", sum(least(len(w), own))::BIGINT AS n FROM split GROUP BY "row"'
        self.count = f"""
            WITH words AS (SELECT "row", piece, own, unnest(w) AS w0, generate_subscripts(w, 1) AS place FROM split),
            hashed AS (SELECT "row", piece, own, place, crc(w0) AS c0, strlen(w0)::INTEGER AS z0 FROM words),
            grams AS (SELECT "row", own, place, c0{after} FROM hashed WINDOW p AS (PARTITION BY piece ORDER BY place)),
            features AS (SELECT "row", unnest([{", ".join(runs)}]) AS hash FROM grams WHERE place <= own)
            SELECT "row", (hash % {n_buckets})::INTEGER AS bucket, count(*) AS n
            FROM features WHERE hash IS NOT NULL GROUP BY "row", bucket ORDER BY "row", bucket"""

    def __call__(self, rows: np.ndarray, texts: pa.Array, own: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Words of each row, and (row, bucket, n). Of a text only the runs count that begin with one of its first ``own`` words."""
        pieces = pa.table({"row": rows, "piece": np.arange(len(rows)), "text": texts, "own": own})
        self.con.register("pieces", pieces)
        self.con.execute(self.split)
        out = self.con.execute(self.words).fetchnumpy(), self.con.execute(self.count).fetchnumpy()
        self.con.unregister("pieces")
        return out


def few(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches, so many at a time, as what is made of them is several times as large."""
    for b in batches:
        for at in range(0, b.num_rows, n):
            yield b.slice(at, n)


def pieces(texts: Texts, longest: int, limit: int) -> Iterator[tuple[bytes, int]]:
    """The only text of a block, cut between words: pieces of about ``limit`` bytes, each with the words after it that its last runs need, and its own number of words."""
    runs = Runs(texts, WORD_BYTES[texts.data])
    n, at = len(runs), 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(runs.ends, runs.starts[at] + limit, side="right")))
        last = min(n, to + longest - 1)
        yield texts.data[runs.starts[at] : runs.ends[last - 1]].tobytes(), to - at
        at = to


def counted(docs: DataFrame, *, n_buckets: int = BUCKETS, longest: int = LONGEST, limit: int = BLOCK, key: str = "doc_id") -> DataFrame:
    """Each row's (doc_id, n_words, n_features, buckets, counts): the buckets of its features and how often each occurs."""

    def run(batches):
        count = Counter(n_buckets, longest)
        for b in few(batches, 2 * ROWS):
            for block in blocks(b.column(1), limit):
                n = len(block)
                words = np.zeros(n, np.int64)
                if n == 1 and len(block.data) > limit:
                    total = np.zeros(n_buckets, np.int64)
                    for text, own in pieces(block, longest, limit):
                        w, c = count(np.zeros(1, np.int64), pa.array([text], pa.binary()).cast(pa.string()), np.array([own]))
                        words[0] += w["n"].sum()
                        total[c["bucket"]] += c["n"]
                    bucket = np.flatnonzero(total)
                    row, number = np.zeros(len(bucket), np.int64), total[bucket]
                else:
                    own = b.column(1).slice(int(block.rows[0]), n).fill_null("")
                    w, c = count(np.arange(n), own, np.full(n, 2**62))
                    words[w["row"]] = w["n"]
                    row, bucket, number = c["row"], c["bucket"], c["n"]
                ends = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((bucket, pa.int32()), (number, pa.int32()))]
                features = np.add.reduceat(np.append(number, 0), np.minimum(ends, len(number))[:-1]) * (np.diff(ends) > 0) if n else words
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(int(block.rows[0]), n), pa.array(words), pa.array(features.astype(np.int64)), *lists],
                    ["doc_id", "n_words", "n_features", "buckets", "counts"]
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {kind}, n_words long, n_features long, buckets array<int>, counts array<int>"
    )


def totals(counts: DataFrame, n_buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows of ``counts``: as many numbers as there are buckets."""
    each = counts.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy(F.col("x.buckets").alias("bucket"))
    out = np.zeros(n_buckets, np.int64)
    for r in each.agg(F.sum("x.counts").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(ours: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, a thousand times the logarithm of its smoothed share in the target over that in ours, rounded down."""
    n, size, aim = len(ours), float(ours.sum()), float(target.sum())
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * (size + n) / ((s + 1.0) * (aim + n)))) for s, t in zip(ours.tolist(), target.tolist(), strict=True)],
        np.int64
    )


def weighed(counts: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): weight is the sum of the gains of a row's features."""

    def run(batches):
        for b in few(batches, ROWS):
            ends = b.column(3).offsets.to_numpy()
            own = slice(ends[0], ends[-1])
            worth = gain[b.column(3).values.to_numpy()[own]] * b.column(4).values.to_numpy()[own]
            sums, ends = np.concatenate([[0], np.cumsum(worth)]), ends - ends[0]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sums[ends[1:]] - sums[ends[:-1]])], ["doc_id", "n_words", "n_features", "weight"])

    kind = counts.schema["doc_id"].dataType.simpleString()
    return counts.select("doc_id", "n_words", "n_features", "buckets", "counts").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_features long, weight long"
    )


def scored(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """Add ``score``: the weight and Gumbel noise from the id, so that the highest scores are a draw by weight without replacement."""
    ident = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(ident, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return rows.withColumn("score", (F.col("weight") + noise).cast("long"))


def ranked(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with their ``rank`` from 1 by score downwards, then doc_id (null last), and their number."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(partitions(rows.sparkSession), *order, "_row").withColumn("_part", F.spark_partition_id())
    dealt = cut(dealt)
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).collect()  # a row a partition
    held = np.zeros(max((part for part, _ in sizes), default=0) + 1, np.int64)
    for part, n in sizes:
        held[part] = n
    total, before = int(held.sum()), np.cumsum(held) - held
    offset = F.get(F.lit(before.tolist()), F.col("_part"))
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order, "_row"))
    return dealt.withColumn("rank", (place + offset).cast("long")).drop("_row", "_part"), total


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile goes to Python a few rows at a time: Arrow's buffers are outside Spark's own memory, and rows are wide."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(2 * ROWS, int(before)) if int(before) > 0 else 2 * ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def resample(
    docs: DataFrame, target: DataFrame, *, n_buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS,
    percent: int = PERCENT, seed: int = SEED, limit: int = BLOCK
) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): n_words, n_features, weight, score, and its rank if it is drawn.

    ``target`` (text) is what the drawn texts shall resemble. ``percent`` of the rows with ``least_words`` or more
    are drawn, rounded down.
    """
    with small_batches(docs.sparkSession):
        counts = cut(counted(docs, n_buckets=n_buckets, longest=longest, limit=limit))
    aim = counted(target.select(F.lit(0).alias("doc_id"), "text"), n_buckets=n_buckets, longest=longest, limit=limit)
    gain = gains(totals(counts, n_buckets), totals(aim, n_buckets))
    with small_batches(docs.sparkSession):
        rows = cut(scored(weighed(counts, gain), seed))
    placed, n = ranked(rows.where(F.col("n_words") >= least_words))
    drawn = placed.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    return drawn.unionByName(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def op13_importance_resampling(spark, sf_dir):
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
