"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is ``WINDOW`` consecutive words of an item, a shorter item is one window. Its shingles (up to
``SHINGLE`` words) are ordered by rarity over all documents; as containment must be whole, the rarest one
is its necessary prefix: a document without it can't hold the window, and a window whose prefix occurs nowhere
is dropped. Documents give a row for each place of a prefix, with the words around it; these rows are joined to
the windows by the prefix's hash. The prefix's place in the window and in the document bound where the window
begins and must end (length and position), and each such window is then compared word by word.

Two passes over the documents, one for the rarities and one for the places, whatever the size of the benchmark.
What is broadcast is a Bloom filter of the shingles sought, of at most ``MOST_BITS`` bits; beyond what it tells
apart well it only lets more rows through to the join. Windows, rarities and prefixes are tables.

Cases: null and wordless texts have no words and are clean; a null or wordless item has no window; a null
item_id is the empty string; items with the same id count once; repeated documents are separate rows;
empty tables give empty or clean results; other columns are ignored, or kept, whatever their names; very long
texts and items are read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafpress.llm.shared import Runs, Texts, blocks, cut, fresh, map_rows, mix, own_exchange, prepare, rolling, table

WINDOW = 10
SHINGLE = 5
BASE = 0xD6E8FEB86659FD93
#: The filter: bits (32 MB at most), so many for each shingle if that allows, and bits that a shingle sets.
LEAST_BITS, MOST_BITS, BITS_EACH, PROBES = 20, 28, 32, 3
#: Bits of one row of a filter on its way to the driver.
CHUNK = 15
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


class Words:
    """The lower-cased words of a block of texts, and a 64-bit hash of each."""

    def __init__(self, texts: Texts):
        self.data = LOWER[texts.data]
        self.runs = Runs(texts, WORD[self.data])
        ids, distinct = self.runs.encode(self.data)
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()], np.uint64)
        self.symbols = hashes[ids] if len(ids) else np.zeros(0, np.uint64)

    def keys(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The first words of all shingles of ``size`` words, and their hashes."""
        n = len(self.runs) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.runs.text_of[:n] == self.runs.text_of[size - 1 :])
        return at, mix(rolling(self.symbols, size, BASE) ^ np.uint64(size))[at]

    def text(self, a: int, b: int) -> str:
        """Words a to b, joined by spaces."""
        return " ".join(self.data[s:e].tobytes().decode() for s, e in zip(self.runs.starts[a:b].tolist(), self.runs.ends[a:b].tolist(), strict=True))


def item_windows(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """(item, w, n, keys): each window of each item, its number of words, and the hashes of its shingles in order."""

    def run(batches):
        for b in batches:
            for texts in blocks(b.column(1), 1 << 18):
                words = Words(texts)
                first = words.runs.first
                keys = {}
                for size in range(1, shingle + 1):
                    keys[size] = np.zeros(len(words.runs), np.uint64)
                    at, own = words.keys(size)
                    keys[size][at] = own
                out = []
                for i in range(len(texts)):
                    item, total = b.column(0)[int(texts.rows[i])].as_py() or "", int(first[i + 1] - first[i])
                    n = min(total, window)
                    size = min(n, shingle)
                    for a in range(int(first[i]), int(first[i + 1]) - n + 1) if n else ():
                        out.append((item, words.text(a, a + n), n, keys[size][a : a + n - size + 1].view(np.int64).tolist()))
                if out:
                    item, w, n, own = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(item, pa.string()), pa.array(w, pa.string()), pa.array(n, pa.int32()),
                            pa.array(own, pa.list_(pa.int64()))
                        ],
                        ["item", "w", "n", "keys"]
                    )

    return benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(run, "item string, w string, n int, keys array<long>")


class Filter:
    """A Bloom filter of 64-bit hashes."""

    def __init__(self, keys: DataFrame):
        """Of a table of distinct ``h``."""
        wanted = max(1, keys.count()) * BITS_EACH
        self.log = log = min(MOST_BITS, max(LEAST_BITS, (wanted - 1).bit_length()))
        self.bits = np.zeros(1 << (log - 3), np.uint8)

        def positions(batches):
            for b in batches:
                h = b.column(0).to_numpy().view(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([probe(h, k, log) for k in range(PROBES)])))], ["p"])

        def packed(key, group):
            bits = np.zeros(1 << CHUNK, np.uint8)
            bits[group.column("p").to_numpy() & ((1 << CHUNK) - 1)] = 1
            return pa.table(
                {
                    "chunk": pa.array([key[0].as_py()], pa.int64()),
                    "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())
                }
            )

        places = keys.select("h").mapInArrow(positions, "p long").distinct()
        chunks = places.withColumn("chunk", F.shiftright("p", CHUNK)).groupBy("chunk").applyInArrow(packed, "chunk long, bits binary")
        for row in chunks.toLocalIterator():
            at = row["chunk"] << (CHUNK - 3)
            self.bits[at : at + (1 << (CHUNK - 3))] = np.frombuffer(row["bits"], np.uint8)[: len(self.bits)]

    def may_have(self, h: np.ndarray) -> np.ndarray:
        """Indices of the hashes that may be in the set."""
        at = np.arange(len(h))
        for k in range(PROBES):
            p = probe(h[at], k, self.log)
            at = at[(self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0]
        return at


def probe(h: np.ndarray, k: int, log: int) -> np.ndarray:
    """The k-th bit of hashes: other bits of the hash at first, then of its scrambles."""
    return ((mix(h + np.uint64(k)) if k else h) >> np.uint64(64 - log)).astype(np.int64)


def occurrences(docs: DataFrame, sought, sizes: list[int]) -> DataFrame:
    """(h, times) over all documents of the shingles that the filter lets through."""

    def run(batches):
        for b in batches:
            for texts in blocks(b.column(0)):
                words, found = Words(texts), []
                for size in sizes:
                    _, h = words.keys(size)
                    found.append(h[sought.value.may_have(h)])
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("times"))


PLACES = "array<struct<h:long,p:int,before:int,words:string>>"


def places(docs: DataFrame, sought, sizes: list[int], window: int, names: tuple[str, str, str], texts_too: bool) -> DataFrame:
    """``docs`` with a row id, the number of words, and the places of shingles that may be prefixes: with the words
    around (the shingle's first is ``before`` words into them). Written, so that the ids stay."""
    at = docs.columns.index("text")
    kind = pa.list_(pa.struct([("h", pa.int64()), ("p", pa.int32()), ("before", pa.int32()), ("words", pa.string())]))

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for b in batches:
            n_words, found = [], []
            for texts in blocks(b.column(at)):
                words = Words(texts)
                first = words.runs.first
                n_words.append(np.diff(first))
                own: list[list[dict]] = [[] for _ in range(len(texts))]
                for size in sizes:
                    p, h = words.keys(size)
                    some = sought.value.may_have(h)
                    for p, h in zip(p[some].tolist(), h[some].view(np.int64).tolist(), strict=True):
                        i = int(words.runs.text_of[p])
                        lo, hi = max(int(first[i]), p - window + size), min(int(first[i + 1]), p + window)
                        own[i].append({"h": h, "p": p - int(first[i]), "before": p - lo, "words": words.text(lo, hi)})
                found += own
            n = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
            ids = pa.array(np.arange(row, row + len(n)), pa.int64())
            row += len(n)
            columns = list(b.columns)
            if not texts_too:
                columns[at] = pa.nulls(b.num_rows, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(
                [*columns, ids, pa.array(n, pa.int64()), pa.array(found, kind)], [*b.schema.names, "row", "n_words", "places"]
            )

    marked = map_rows(docs, run, f", row long, n_words long, places {PLACES}", names)
    return cut(marked if texts_too else marked.drop("text"))


def windows_held(
    docs: DataFrame, benchmark: DataFrame, window: int, shingle: int, *, texts_too: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame, tuple[str, str, str]]:
    """``docs`` with row ids, words and places (named by the last result); (row, first, end, w) of all windows that occur; (item, w)."""
    spark = prepare(docs.sparkSession)
    names = tuple(fresh(docs, "__row", "__n_words", "__places"))
    items = cut(item_windows(benchmark, window, shingle))
    distinct = items.groupBy("w").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    sizes = sorted(r[0] for r in items.select(F.least("n", F.lit(shingle))).distinct().collect())  # of 1 to ``shingle``
    sought = spark.sparkContext.broadcast(Filter(distinct.select(F.explode("keys").alias("h")).distinct()))
    times = occurrences(docs, sought, sizes) if sizes else spark.createDataFrame([], "h long, times long")
    ordered = distinct.select("w", "n", F.posexplode("keys").alias("offset", "h")).join(own_exchange(times, "h"), "h", "left")
    rarest = F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "h", "offset")).alias("best")
    prefixes = cut(ordered.groupBy("w").agg(F.first("n").alias("n"), rarest).where("best.times > 0").select("w", "n", "best.h", "best.offset"))
    sought.unpersist()
    sought = spark.sparkContext.broadcast(Filter(prefixes.select("h").distinct()))
    marked = places(docs, sought, sizes, window, names, texts_too)
    sought.destroy()
    # length and position first, then every word
    begin = F.col("before") - F.col("offset")
    fits = (begin >= 0) & (F.slice(F.split("words", " "), begin + 1, F.col("n")) == F.split("w", " "))
    each = marked.where(F.size(names[2]) > 0).select(F.col(names[0]).alias("row"), F.inline(names[2]))
    held = each.join(prefixes, "h").where(F.when(begin >= 0, fits).otherwise(F.lit(False)))
    held = held.select("row", (F.col("p") - F.col("offset")).alias("first"), (F.col("p") - F.col("offset") + F.col("n")).alias("end"), "w")
    return marked, cut(held), items.select("item", "w"), names


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per row: doc_id, the contract's columns, ``hits`` (int32 pairs: first and end word) and ``items``."""
    marked, held, windows, (row, n_words, _) = windows_held(docs.select("doc_id", "text"), benchmark, window, shingle)

    def unite(batches):
        for b in batches:
            spans = [union(np.stack([x.values.field(k).to_numpy() for k in (0, 1)], 1)) for x in b.column(1)]
            n = [int((s[:, 1] - s[:, 0]).sum()) for s in spans]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array([s.astype(np.int32).tobytes() for s in spans], pa.binary())],
                ["row", "n_hit", "hits"]
            )

    hits = held.groupBy("row").agg(F.collect_set(F.struct("first", "end")).alias("spans")).mapInArrow(unite, "row long, n_hit long, hits binary")
    found = held.select("row", "w").distinct().join(windows.distinct(), "w").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = marked.select("doc_id", F.col(row).alias("row"), F.col(n_words).alias("n_words")).join(hits, "row", "left").join(found, "row", "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), digest(names).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), F.coalesce("hits", F.lit("").cast("binary")).alias("hits"), names.alias("items")
    )


def digest(names: Column) -> Column:
    return F.sha2(F.array_join(names, ","), 256)


def union(spans: np.ndarray) -> np.ndarray:
    """Disjoint sorted spans that cover the same words."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(spans) - 1]])]], 1)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` in which no window occurs, with their own columns; rows without a prefix are not shuffled.

    Null and wordless texts stay, an empty benchmark keeps all, repeated rows are judged alike.
    """
    marked, held, _, (row, _, at) = windows_held(docs, benchmark, window, shingle, texts_too=True)
    dirty = held.select(F.col("row").alias(row)).distinct()
    own = [F.col(f"`{c}`") for c in docs.columns]
    without = marked.where(F.size(at) == 0).select(*own)
    return without.unionAll(marked.where(F.size(at) > 0).join(dirty, row, "left_anti").select(*own))


def op6_decontaminate(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hits", "items")
