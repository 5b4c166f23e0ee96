"""What the operators of this subpackage share: the scratch folder, table access, and packing of text batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafpress.ship import prepare

#: Bytes of text that one numpy pass holds at once; a longer single text is a block of its own.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="leafpress-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base


#: Paths of the tables that ``cut`` wrote in this process.
MADE: list[str] = []


def drop_made(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Delete the tables made after the first ``since``, but ``keep``: all that a finished step left behind."""
    for path in MADE[since:]:
        if path != keep._leafpress_path:
            delete(spark, path)
    MADE[since:] = [keep._leafpress_path]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: ends the lineage, and lets readers prune columns."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._leafpress_path = path
    MADE.append(path)
    return out


def delete(spark: SparkSession, path: str) -> None:
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


def discard(table: DataFrame) -> None:
    """Delete a table made by ``cut`` that no later action reads, neither itself nor through what derives from it."""
    delete(table.sparkSession, table._leafpress_path)


def release(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once no result that reads them is needed any more."""
    delete(spark, f"{scratch_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for own use that no column of ``df`` has (whatever the case), from ``names``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def map_rows(df: DataFrame, run: Callable, more: str = "", names: tuple[str, ...] = ()) -> DataFrame:
    """``mapInArrow`` over all columns of ``df``, whatever their names, which stay; ``more`` types further ones, ``names`` names them."""
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(run, fields + more).toDF(*df.columns, *names)


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def own_exchange(df: DataFrame, key: str) -> DataFrame:
    """``df``, an aggregate by the long or binary ``key``, with the key as a new expression.

    A join on it then shuffles the aggregate's result again instead of reusing its exchange. Both sides of the join
    are plain shuffles, and only such joins are split by adaptive execution where a key is hot.
    """
    if df.schema[key].dataType.simpleString() == "binary":
        return df.withColumn(key, F.concat(F.col(key), F.lit(b"")))
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("long")))


#: Bits of the filter that ``near_keys`` makes (2 MB at most, in bitmaps of 2 ** 15 bits).
FILTER_BITS = 1 << 24


def near_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``df`` without most of the rows whose ``key`` is not in ``keys``, and with all others: bitmaps of a bounded size are sent to all tasks.

    A join with ``keys`` then shuffles little else than what it finds, up to some million keys; it may follow with any number.
    """
    spot, bucket, bits = fresh(df, "__spot", "__bucket", "__bits")
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    maps = keys.select(place.alias(spot)).groupBy(F.bitmap_bucket_number(spot).alias(bucket))
    maps = maps.agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias(bits))
    at = F.bitmap_bit_position(spot)
    byte = F.conv(F.hex(F.substring(F.col(bits), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1) == 1
    placed = df.withColumn(spot, place).withColumn(bucket, F.bitmap_bucket_number(spot))
    return placed.join(F.broadcast(maps), bucket).where(may).drop(spot, bucket, bits)


@contextmanager
def batches_of(spark: SparkSession, n: int) -> Iterator[None]:
    """What is written meanwhile goes to Python at most so many rows at a time, as rows are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, n)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def by_key(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition by ``cols`` and sort inside, for Python code that streams over runs of a key."""
    return df.repartition(partitions(df.sparkSession), *cols)


class Texts:
    """A block of whole texts: UTF-8 bytes in one array, ``offsets`` of each text, and the rows they come from."""

    def __init__(self, array: pa.Array, rows: np.ndarray):
        buffers = array.buffers()
        offsets = np.frombuffer(buffers[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
        whole = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        self.data = whole[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Texts]:
    """The texts (or binaries) of a column (null: empty) in blocks of about ``limit`` bytes, each text whole."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = pc.fill_null(column.cast(pa.large_binary() if binary else pa.large_string()), b"" if binary else "")
    n = len(column)
    if not n:
        return
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
        yield Texts(column.slice(at, to - at), np.arange(at, to))
        at = to


def byte_set(members: bytes, *, complement: bool = False) -> np.ndarray:
    lut = np.zeros(256, bool)
    lut[list(members)] = True
    return ~lut if complement else lut


#: Bytes of words ``[^\x20\x09-\x0D]+``: in UTF-8 these are all bytes but six.
WORD_BYTES = byte_set(b"\x20\x09\x0a\x0b\x0c\x0d", complement=True)


class Runs:
    """Maximal runs of the bytes in ``inside``, never across texts: ``starts``, ``ends`` and ``first`` (index of each text's first run)."""

    def __init__(self, texts: Texts, inside: np.ndarray):
        n = len(texts.data)
        edge = np.zeros(n + 1, bool)
        edge[texts.offsets] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = inside[:-1]
        before &= ~edge[:n]
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        after &= ~edge[1:]
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, texts.offsets)
        self.inside = inside
        self.text_of = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.starts)

    def encode(self, data: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Exact ids of the runs' contents, and the distinct contents."""
        return encode(data[self.inside], self.ends - self.starts)


def encode(packed: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Dictionary-encode the byte strings of ``lengths`` that lie one after another in ``packed``."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    array = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(packed))]
    )
    coded = array.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (the finaliser of SplitMix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def rolling(symbols: np.ndarray, length: int, base: int) -> np.ndarray:
    """Polynomial hash (modulo 2**64) of every ``length`` consecutive 64-bit symbols, by doubling; unscrambled."""
    n = len(symbols) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, have, power, size, at = None, symbols, base & (2**64 - 1), 1, 0
    while True:
        if length & size:  # append a block of `size` symbols at offset `at`
            part = have[at : at + n]
            total = part.copy() if total is None else total * np.uint64(power) + part
            at += size
        if size * 2 > length:
            return total
        have = have[:-size] * np.uint64(power) + have[size:]
        power, size = power * power & (2**64 - 1), size * 2


def same_windows(ids: np.ndarray, p: np.ndarray, q: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` ids from each place of ``p`` are those from the place of ``q`` beside it."""
    out = np.ones(len(p), bool)
    for j in range(length):
        out &= ids[p + j] == ids[q + j]
    return out


def window_codes(ids: np.ndarray, length: int) -> np.ndarray:
    """Exact codes of every ``length`` consecutive ids, by doubling: equal codes, equal windows. The way out where hashes collide."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)

    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]

    total, have, size, at = None, np.unique(ids, return_inverse=True)[1].astype(np.int64), 1, 0
    while True:
        if length & size:
            part = have[at : at + n]
            total = part if total is None else pair(total, part)
            at += size
        if size * 2 > length:
            return total
        have = pair(have[:-size], have[size:])
        size *= 2
