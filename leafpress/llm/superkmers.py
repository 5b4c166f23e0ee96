"""Repeated windows of a table of texts: super-k-mers dealt by minimiser, counted exactly in their buckets.

A window is ``length`` consecutive units (bytes or words) of one text. The minimiser of a window is the
least hash of its k-mers of ``k`` units; consecutive windows with the same one are a super-k-mer (at most
``MOST_WINDOWS`` windows, so that a periodic text is many small ones). Equal windows have equal minimisers, so a
minimiser that occurs in one super-k-mer only needs no text: the minimisers are counted first (pre-aggregated),
and only super-k-mers of repeated ones travel, each as one packed string, to their bucket. The unit's ``classes``
then tells equal windows there by their content.

A minimiser with more than ``hot`` super-k-mers is split by salt into shards of about that many. A shard finds
its own repeats in the same way, and sends its distinct windows on, consecutive ones as one packed string. These
strings are cut again by minimisers of longer k-mers (``ks``, each half as far from the window as the one before, so that
a string becomes a few pieces a deal) and dealt to new buckets, where the shards' windows
meet and are told apart by the same ``classes``; the last k is the whole window, so a bucket that is still hot
there holds copies of one window, of which each shard sends one. So the method and what decides are the same at
every size, no group of any size is gathered in one task, and nothing is left out. Hashes only deal; equality is
decided by content (equal whole texts: by SHA-256).

Texts are read once, and written compressed next to their super-k-mers' places; equal texts are one text with a
multiplicity, and only its first copy travels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafpress.llm.shared import WORD_BYTES, Runs, Texts, blocks, cut, discard, mix, own_exchange, partitions, prepare, rolling

BASE_K = 0x9E3779B97F4A7C15
HOT = 1_000
#: Windows of one super-k-mer.
MOST_WINDOWS = 4_096
#: Bytes of texts that one pass of the minimiser holds.
PASS_BYTES = 1 << 18
#: Bytes of packed super-k-mers that are solved at once, if the last group is complete.
BUCKET_BYTES = 1 << 18
#: Super-k-mers of one row batch.
ROWS = 200_000


def halvings(k: int, length: int) -> list[int]:
    """``k`` and longer ones up to ``length``, each half as far from it as the one before.

    A string whose minimiser is hot at one k has at most ``length`` - k + 1 windows; the next k cuts it into a few pieces,
    where the whole window at once would make each window a piece.
    """
    out = [min(k, length)]
    while out[-1] < length:
        out.append(length - (length - out[-1]) // 2)
    return out


class Bytes:
    """Units are the UTF-8 bytes. ``bits`` shortens the hashes, for tests."""

    name = "bytes"

    def __init__(self, length: int = 200, bits: int = 64):
        self.length, self.bits = length, bits
        self.ks = (24, *halvings(length // 2, length))
        self.symbols = mix(np.arange(1, 257, dtype=np.uint64))

    def read(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit symbol of each unit, and where each text's units begin."""
        return self.symbols[texts.data], texts.offsets

    def pack(self, raw: bytes, cuts: list[tuple[int, int]]) -> list[bytes]:
        return [raw[a:b] for a, b in cuts]

    def digest(self, raw: bytes) -> str | None:
        """Of the kept text where nothing is removed; none: that of the text itself."""
        return None


class Words:
    """Units are the words ``[^\\x20\\x09-\\x0D]+``. ``bits`` shortens the hashes, for tests."""

    name = "words"

    def __init__(self, length: int = 35, bits: int = 64):
        self.length, self.bits = length, bits
        self.ks = (8, *halvings(20, length))

    def read(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        runs = Runs(texts, WORD_BYTES[texts.data])
        ids, distinct = runs.encode(texts.data)
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()], np.uint64)
        return hashes[ids] if len(ids) else np.zeros(0, np.uint64), runs.first

    def pack(self, raw: bytes, cuts: list[tuple[int, int]]) -> list[bytes]:
        words = raw.split()
        return [b" ".join(words[a:b]) for a, b in cuts]

    def digest(self, raw: bytes) -> str | None:
        return hashlib.sha256(b" ".join(raw.split())).hexdigest()


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    have, size = values, 1
    while size * 2 <= width:
        have = np.minimum(have[:-size], have[size:])
        size *= 2
    return np.minimum(have[: len(values) - width + 1], have[width - size :]) if width > size else have


def super_kmers(symbols: np.ndarray, first: np.ndarray, length: int, k: int, bits: int = 64) -> tuple[np.ndarray, ...]:
    """(text, first unit in it, number of windows, minimiser, whether that occurs in it again) of each super-k-mer."""
    n = len(symbols) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, bool))
    hashes, width = mix(rolling(symbols, k, BASE_K)) >> np.uint64(64 - bits), length - k + 1
    least = sliding_min(hashes, width)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    inside = np.arange(n) + length <= first[text + 1]
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]]) & inside
    a = np.flatnonzero(new)
    last = np.concatenate([new[1:] | ~inside[1:], [True]]) & inside
    b = np.flatnonzero(last) + 1
    if len(a) and int((b - a).max()) > MOST_WINDOWS:  # equal windows keep their minimiser, wherever a run is cut
        pieces = -(-(b - a) // MOST_WINDOWS)
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        a, b = np.repeat(a, pieces) + nth * MOST_WINDOWS, np.repeat(b, pieces)
        b = np.minimum(b, a + MOST_WINDOWS)
    # places where a k-mer is the minimiser of some window: there the greatest minimum of the windows around is its own hash
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    at = np.flatnonzero(~sliding_min(~padded, width) == hashes)
    values, code = np.unique(np.concatenate([hashes[at], least[a]]), return_inverse=True)
    places = np.sort(code[: len(at)] * np.int64(len(symbols) + 1) + at)
    low = code[len(at) :] * np.int64(len(symbols) + 1) + a
    again = np.searchsorted(places, low + (b - a) + width - 1) - np.searchsorted(places, low) > 1
    return text[a], a - first[text[a]], b - a, least[a], again


def cover(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rows (first window, end window) as bytes."""
    return np.stack([starts, starts + counts], 1).astype(np.uint32)


def as_runs(flags: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true flags inside a group: where they begin and end."""
    edge = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
    before = np.concatenate([[False], flags[:-1]]) & ~edge
    after = np.concatenate([flags[1:], [False]]) & ~np.concatenate([edge[1:], [True]])
    return np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after) + 1


STRINGS = "m long, salt int, uid long, start int, times long, again boolean, once boolean, s binary"
SOLVED = "uid long, packed binary, start int, once boolean, s binary"


def solver(unit, classes: Callable, hot: int) -> Callable:
    """For ``mapInArrow`` over strings (``STRINGS``) sorted by bucket: the spans of repeated windows (uid, packed),
    and of buckets that are shards of a hot one the distinct windows (uid, start, once, s), for the next deal."""
    length = unit.length

    def bucket(batches):
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.nbytes
            if size < BUCKET_BYTES:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            m, salt = rows.column("m").to_numpy(), rows.column("salt").to_numpy()
            ends = np.flatnonzero((m[1:] != m[:-1]) | (salt[1:] != salt[:-1])) + 1
            if len(ends):
                yield from solve(rows.slice(0, int(ends[-1])))
                rows = rows.slice(int(ends[-1]))
            held, size = rows.to_batches(), rows.nbytes if not len(ends) else 0
        if held:
            yield from solve(pa.Table.from_batches(held).combine_chunks())

    def solve(rows: pa.Table):
        m, uid, start, times, again, once = (rows.column(n).to_numpy() for n in ("m", "uid", "start", "times", "again", "once"))
        # equal strings, which have the same minimiser, are one with a multiplicity
        coded = rows.column("s").combine_chunks().cast(pa.large_binary()).dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        code, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        row = np.zeros(len(distinct), np.int64)
        row[code[::-1]] = np.arange(len(code))[::-1]
        texts = Texts(distinct, np.arange(len(distinct)))
        first = texts.offsets if unit.name == "bytes" else Runs(texts, WORD_BYTES[texts.data]).first
        windows = np.diff(first) - length + 1
        at = np.concatenate([[0], np.cumsum(windows)])
        owner = np.repeat(np.arange(len(distinct)), windows)
        # a string alone with its minimiser, which it holds once, has no window in common with any string
        _, kin, size = np.unique(m[row], return_inverse=True, return_counts=True)
        asked = size[kin] > 1
        asked[code[again]] = True
        label = np.arange(len(owner))
        if asked.any():
            got = classes(Texts(distinct.filter(pa.array(asked)), np.arange(int(asked.sum()))))
            label += int(got.max(initial=0)) + 1
            label[asked[owner]] = got
        copies = np.bincount(code, minlength=len(distinct))
        flags = np.bincount(label, weights=copies[owner])[label] > 1
        yield from spans(flags, owner, at, code, np.flatnonzero(once), uid, start)
        split = times[row] > hot
        if split.any():
            yield from onward(flags, owner, at, label, split, distinct, uid[row], start[row], once, code)

    def spans(flags, owner, at, code, rows, uid, start):
        """The repeated windows of ``rows`` of strings."""
        lo, hi = as_runs(flags, owner)
        bounds = np.searchsorted(owner[lo] if len(lo) else lo, np.arange(len(at)))
        found = [cover(lo[p:q] - at[i], hi[p:q] - lo[p:q]) for i, (p, q) in enumerate(zip(bounds, bounds[1:], strict=False))]
        some = [k for k in rows if len(found[code[k]])]
        if some:
            n = len(some)
            packed = [(found[code[k]] + np.uint32(start[k])).tobytes() for k in some]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(uid[some]), pa.array(packed, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_()),
                    pa.nulls(n, pa.binary())
                ],
                ["uid", "packed", "start", "once", "s"]
            )

    def onward(flags, owner, at, label, split, distinct, uid, start, once, code):
        """The first of each class of windows, in runs that are all repeated or all single so far."""
        lead = np.zeros(len(owner), bool)
        lead[np.unique(label, return_index=True)[1]] = True
        lead &= split[owner]
        settled = np.ones(len(distinct), bool)  # strings whose rows are all known as repeated
        settled[code[once]] = False
        single = ~flags & ~settled[owner]
        for now in (True, False):
            lo, hi = as_runs(lead & (single == now), owner)
            out, size = [], 0
            for p, q in zip(lo.tolist(), hi.tolist(), strict=True):
                i = int(owner[p])
                raw, a = distinct[i].as_py(), p - int(at[i])
                s = raw if q - p == at[i + 1] - at[i] else unit.pack(raw, [(a, a + q - p + length - 1)])[0]
                out.append((int(uid[i]), int(start[i]) + a, s))
                size += len(s)
                if size > BUCKET_BYTES:
                    yield sent(out, now)
                    out, size = [], 0
            if out:
                yield sent(out, now)

    def sent(out, once):
        uid, start, s = zip(*out, strict=True)
        n = len(out)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(uid, pa.int64()), pa.nulls(n, pa.binary()), pa.array(start, pa.int32()), pa.array([once] * n),
                pa.array(s, pa.binary())
            ],
            ["uid", "packed", "start", "once", "s"]
        )

    return bucket


def cutter(unit, deal: int) -> Callable:
    """For ``mapInArrow`` over (uid, start, once, s): the strings cut by the minimisers of a later deal, as (m, uid, start, again, once, s)."""
    k, bits = unit.ks[min(deal, len(unit.ks) - 1)], min(64, unit.bits + 16 * deal)

    def run(batches):
        for b in batches:
            uid, start, once = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for texts in blocks(b.column(3), PASS_BYTES):
                symbols, first = unit.read(texts)
                text, at, count, least, again = super_kmers(symbols, first, unit.length, k, bits)
                row = texts.rows[text]
                cuts = np.searchsorted(text, np.arange(len(texts) + 1))
                s = []
                for i in range(len(texts)):
                    own = slice(cuts[i], cuts[i + 1])
                    s += unit.pack(texts.raw(i), list(zip(at[own].tolist(), (at[own] + count[own] + unit.length - 1).tolist(), strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(least.view(np.int64)), pa.array(uid[row]), pa.array((start[row] + at).astype(np.int32)), pa.array(again),
                        pa.array(once[row]), pa.array(s, pa.binary())
                    ],
                    ["m", "uid", "start", "again", "once", "s"]
                )

    return run


def bucketed(strings: DataFrame) -> DataFrame:
    return strings.repartition(partitions(strings.sparkSession), "m", "salt").sortWithinPartitions("m", "salt")


def read_marks(docs: DataFrame, unit) -> DataFrame:
    """(doc_id, uid, key, n_units, whole, ends, packed, z) of each row: the text's SHA-256, its super-k-mers' places, the text compressed."""
    spark, length = prepare(docs.sparkSession), unit.length
    kind = docs.schema["doc_id"].dataType.simpleString()

    def mark(batches):
        from pyspark import TaskContext

        at, make = TaskContext.get().partitionId() << 33, zstandard.ZstdCompressor(level=1)
        for b in batches:
            for texts in blocks(b.column(1), PASS_BYTES):
                symbols, first = unit.read(texts)
                text, start, count, least, again = super_kmers(symbols, first, length, unit.ks[0], unit.bits)
                count = count | again.astype(np.int64) << 31  # the top bit
                cuts = np.searchsorted(text, np.arange(len(texts) + 1))
                packed, z, key, whole = [], [], [], []
                for i in range(len(texts)):
                    lo, hi = cuts[i], cuts[i + 1]
                    raw = texts.raw(i)
                    packed.append(least[lo:hi].tobytes() + start[lo:hi].astype(np.uint32).tobytes() + count[lo:hi].astype(np.uint32).tobytes())
                    z.append(make.compress(raw))
                    key.append(hashlib.sha256(raw).digest())
                    whole.append(unit.digest(raw))
                n, units = len(texts), np.diff(first)
                ends = [np.array([0, u]).tobytes() for u in units]
                cols = [
                    b.column(0).slice(int(texts.rows[0]), n), pa.array(np.arange(at, at + n), pa.int64()), pa.array(key, pa.binary()),
                    pa.array(units, pa.int64()), pa.array(whole, pa.string()), pa.array(ends, pa.binary()), pa.array(packed, pa.binary()),
                    pa.array(z, pa.binary())
                ]
                at += n
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "uid", "key", "n_units", "whole", "ends", "packed", "z"])

    return cut(
        docs.select("doc_id", "text").mapInArrow(
            mark, f"doc_id {kind}, uid long, key binary, n_units long, whole string, ends binary, packed binary, z binary"
        )
    )


def unpack(batches):
    """(m, uid, start, count, again) of the packed places."""
    for b in batches:
        uid = b.column(0).to_numpy()
        data = [np.frombuffer(x, np.uint8) for x in b.column(1).to_pylist()]
        sizes = np.array([len(x) // 16 for x in data], np.int64)
        if not sizes.sum():
            continue
        least = np.concatenate([x[: 8 * n] for x, n in zip(data, sizes, strict=True)]).view(np.int64)
        start = np.concatenate([x[8 * n : 12 * n] for x, n in zip(data, sizes, strict=True)]).view(np.int32)
        count = np.concatenate([x[12 * n :] for x, n in zip(data, sizes, strict=True)]).view(np.int32)
        owner = np.repeat(uid, sizes)
        again, count = count < 0, count & 0x7FFFFFFF
        for lo in range(0, len(owner), ROWS):
            s = slice(lo, lo + ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(x[s]) for x in (least, owner, start, count, again)], ["m", "uid", "start", "count", "again"])


def repeated_windows(marked: DataFrame, reps: DataFrame, unit, classes: Callable, hot: int = HOT) -> DataFrame:
    """(uid, spans) of the distinct texts: their repeated windows as uint32 pairs in binaries.

    ``classes(Texts)`` gets packed strings and returns a label of each window of them, one after another: equal
    labels, equal windows.
    """
    length = unit.length
    runs = marked.select("uid", "packed").join(reps.select("uid"), "uid", "left_semi").mapInArrow(
        unpack, "m long, uid long, start int, count int, again boolean"
    )
    often = runs.groupBy("m").agg(F.count(F.lit(1)).alias("times"), F.max("again").alias("again")).where("times > 1 or again").select("m", "times")
    asked = runs.join(own_exchange(often, "m"), "m").groupBy("uid").agg(
        F.collect_list(F.struct("m", "start", "count", "times", "again")).alias("asked")
    )

    def travel(batches):
        """The packed super-k-mers of a text."""
        make = zstandard.ZstdDecompressor()
        for b in batches:
            out, size = [], 0
            for uid, z, asked in zip(*(b.column(i) for i in range(3)), strict=True):
                own, raw, rows = uid.as_py(), make.decompress(z.as_buffer()), asked.values
                m, start, count, times, again = (rows.field(n).to_numpy(zero_copy_only=False) for n in ("m", "start", "count", "times", "again"))
                strings = unit.pack(raw, list(zip(start.tolist(), (start + count + length - 1).tolist(), strict=True)))
                shards = -(-times // hot)
                salt = (mix(np.full(len(m), own, np.uint64)) % shards.astype(np.uint64)).astype(np.int32)
                out.append((m, salt, np.full(len(m), own, np.int64), start, times, again, strings))
                size += sum(map(len, strings))
                if size > BUCKET_BYTES:
                    yield packed_rows(out)
                    out, size = [], 0
            if out:
                yield packed_rows(out)

    def packed_rows(out):
        cols = [pa.array(np.concatenate([x[i] for x in out])) for i in range(6)]
        n = len(cols[0])
        return pa.RecordBatch.from_arrays(
            [*cols, pa.array(np.ones(n, bool)), pa.array([s for x in out for s in x[6]], pa.binary())],
            ["m", "salt", "uid", "start", "times", "again", "once", "s"]
        )

    strings = marked.select("uid", "z").join(asked, "uid").select("uid", "z", "asked").mapInArrow(travel, STRINGS)
    solve = solver(unit, classes, hot)
    solved = cut(bucketed(strings).mapInArrow(solve, SOLVED))
    found, deal = solved.where("s is null").select("uid", "packed"), 0
    while not (left := solved.where("s is not null").select("uid", "start", "once", "s")).isEmpty():
        deal += 1
        pieces = cut(left.mapInArrow(cutter(unit, deal), "m long, uid long, start int, again boolean, once boolean, s binary"))
        times = pieces.groupBy("m").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
        salt = F.pmod(F.xxhash64("uid", "start"), F.ceil(F.col("times") / hot)).cast("int")
        met = pieces.join(own_exchange(times, "m"), "m").select("m", salt.alias("salt"), "uid", "start", "times", "again", "once", "s")
        solved = cut(bucketed(met).mapInArrow(solve, SOLVED))
        discard(pieces)
        found = found.unionByName(solved.where("s is null").select("uid", "packed"))
    return found.groupBy("uid").agg(F.collect_list("packed").alias("spans"))


def removed_units(n_units: int, spans: list[bytes] | None, length: int) -> np.ndarray:
    """Disjoint (first, end) of the units that repeated windows cover; touching ones are one."""
    if n_units < length or not spans:
        return np.zeros((0, 2), np.int64)
    rows = np.frombuffer(b"".join(spans), np.uint32).reshape(-1, 2).astype(np.int64)
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    reach = np.maximum.accumulate(rows[:, 1] + length - 1)
    new = np.concatenate([[True], rows[1:, 0] > reach[:-1]])
    return np.stack([rows[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(rows) - 1)]], 1)


def without_repeats(docs: DataFrame, unit, classes: Callable, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_units, n_removed, n_spans, kept_sha256 and, packed, the removed units' bounds (int64 pairs)."""
    marked = read_marks(docs, unit)
    reps = cut(marked.groupBy("key").agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("n")))
    found = repeated_windows(marked, reps, unit, classes, hot)
    names = ["uid", "n_removed", "n_spans", "kept", "removed"]

    def finish(batches):
        make = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for z, spans in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                raw = make.decompress(z.as_buffer())
                units = raw if unit.name == "bytes" else raw.split()
                gone = removed_units(len(units), spans, unit.length)
                kept, at = [], 0
                for lo, hi in gone.tolist():
                    kept.append(units[at:lo])
                    at = hi
                kept.append(units[at:])
                kept = b"".join(kept) if unit.name == "bytes" else b" ".join(w for part in kept for w in part)
                rows.append((int((gone[:, 1] - gone[:, 0]).sum()), len(gone), hashlib.sha256(kept).hexdigest(), gone.astype(np.int64).tobytes()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

    # a text with copies goes whole, so only the others need theirs again
    alone = reps.where("n = 1").select("uid")
    shorter = marked.select("uid", "z").join(found, "uid").join(alone, "uid", "left_semi").select("uid", "z", "spans").mapInArrow(
        finish, "uid long, n_removed long, n_spans long, kept string, removed binary"
    )
    copies = reps.where("n > 1").select("key", F.lit(True).alias("copied"))
    rows = marked.select("doc_id", "uid", "key", "n_units", "whole", "ends").join(copies, "key", "left").join(shorter, "uid", "left")
    gone = F.coalesce(F.col("copied") & (F.col("n_units") >= unit.length), F.lit(False))
    whole = F.coalesce("whole", F.lower(F.hex("key")))
    empty = hashlib.sha256(b"").hexdigest()
    return rows.select(
        "doc_id",
        "n_units",
        F.when(gone, F.col("n_units")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(empty)).otherwise(F.coalesce("kept", whole)).alias("kept_sha256"),
        F.when(gone, F.col("ends")).otherwise(F.coalesce("removed", F.lit("").cast("binary"))).alias("removed"),
    )
