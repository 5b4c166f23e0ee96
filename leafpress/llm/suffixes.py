"""Suffix-array dedup: repeated byte strings by merging shard Burrows-Wheeler transforms.

Candidate stretches of text come in buckets (``superkmers``). The strings of a bucket are two shards or more, which
are merged in rounds, in pairs. As a symbol, a suffix has a block of ``STRIDE`` bytes, so a string is ``STRIDE``
interleaved chains of symbols, and 200 bytes are four symbols. Each shard sorts its own suffixes once and keeps
their order and its transform (the symbol before each suffix). A merge never sorts suffixes again: an interleave,
which says from which shard the next suffix of the merged order comes, is refined by distributing it stably by
the preceding symbols, once per symbol of depth (Holt and McMillan's method). Where neighbours first fall apart
gives their common prefix in symbols; maximal intervals with the full depth in common are the repeated strings.
Blocks with equal hashes are compared byte by byte when they get their symbols, and get exact codes if any differ.

Matches never cross texts, as chains end with their string. Cases: null and empty texts have no bytes and
nothing removed, like texts under 200 bytes; equal texts of 200 bytes and more are removed whole, repeated
rows too; very long texts are one row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from leafpress.llm.shared import Texts, mix, rolling, table, window_codes
from leafpress.llm.superkmers import HOT, Bytes, without_repeats

LENGTH = 200
STRIDE = 50
#: Bytes of strings whose suffixes are sorted together; beyond that, shards' transforms are merged.
SHARD_BYTES = 1 << 17
BASE_A = 0xC2B2AE3D27D4EB4F


def ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of keys, and dense ranks from 1."""
    order = np.argsort(keys)
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.concatenate([[1], keys[order][1:] != keys[order][:-1]])) if len(keys) else 0
    return order, out


def distributed(symbols: np.ndarray) -> np.ndarray:
    """Places by symbol, those of one symbol in the order they had. Symbol and place share one integer, so a plain sort is stable."""
    packed = (symbols << 32) | np.arange(len(symbols))
    packed.sort()
    return packed & 0xFFFFFFFF


def chain(values: np.ndarray, ends: np.ndarray, step: int) -> np.ndarray:
    """``values`` at each place plus ``step``, 0 beyond the string's end."""
    at = np.arange(len(values)) + step
    return np.where(at <= ends, values[np.minimum(at, len(values) - 1)], 0)


def shard_transform(codes: np.ndarray, ends: np.ndarray, starts: np.ndarray, stride: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's suffixes ordered by ``depth`` symbols, and the symbol before each (0: none)."""
    rank, have = codes, 1
    order = np.argsort(codes)
    while have < depth:
        order, rank = ranks(rank * (int(rank.max(initial=0)) + 1) + chain(rank, ends, have * stride))
        have *= 2
    before = order - stride
    return order, np.where(before >= starts[order], codes[np.maximum(before, 0)], 0)


def merge_transforms(first: np.ndarray, second: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave two transforms: from which shard each merged suffix comes, and the common prefix with the one before (symbols, ``depth`` at most)."""
    n = len(first) + len(second)
    z = np.zeros(n, bool)
    z[len(first) :] = True
    block, common = np.zeros(n, np.int64), np.full(n, depth)
    for step in range(depth):
        symbol = np.empty(n, np.int64)
        symbol[~z], symbol[z] = first, second
        order = distributed(symbol)  # no suffix is compared
        z, symbol, block = z[order], symbol[order], block[order]
        apart = np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])])
        common[apart & (common == depth)] = step  # each step refines the last: what is apart stays so
        block = np.cumsum(apart)
    return z, common


def block_codes(data: np.ndarray, full: np.ndarray, stride: int) -> np.ndarray:
    """Dense codes from 1 of the blocks of ``stride`` bytes at the places ``full``: equal codes, equal bytes."""
    hashed = mix(rolling(data.astype(np.uint64) + np.uint64(1), stride, BASE_A))[full]
    order, codes = ranks(hashed)
    again = np.flatnonzero(hashed[order][1:] == hashed[order][:-1])
    p, q = full[order[again]], full[order[again + 1]]
    views = np.lib.stride_tricks.sliding_window_view(data, stride)
    for k in range(0, len(again), 8192):
        if not np.array_equal(views[p[k : k + 8192]], views[q[k : k + 8192]]):  # two blocks share a hash
            return window_codes(data, stride)[full] + 1
    return codes


def merged(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two shards' orders and transforms as one, and the common prefixes of neighbours."""
    z, common = merge_transforms(first[1], second[1], depth)
    order, before = np.empty(len(z), np.int64), np.empty(len(z), np.int64)
    order[~z], order[z] = first[0], second[0]
    before[~z], before[z] = first[1], second[1]
    return order, before, common


def classes(texts: Texts, length: int = LENGTH, stride: int = STRIDE, shard: int = SHARD_BYTES) -> np.ndarray:
    """A label of each window of each string, one after another: equal labels, equal bytes."""
    depth, count = length // stride, len(texts)
    sizes = np.diff(texts.offsets)
    # every string gets one more place, its end, from which its chains are built
    starts = texts.offsets[:-1] + np.arange(count)
    own = np.repeat(np.arange(count), sizes + 1)
    ends, begin = (starts + sizes)[own], starts[own]
    data = np.zeros(len(own), np.uint8)
    data[np.arange(len(texts.data)) + np.repeat(np.arange(count), sizes)] = texts.data
    full = np.flatnonzero(np.arange(len(data)) + stride <= ends)
    codes = np.zeros(len(data), np.int64)
    if len(full):
        codes[full] = block_codes(data, full, stride)
    pieces = max(2, -(-len(data) // shard))
    cuts = np.unique(
        np.concatenate([[0], starts[np.searchsorted(starts, np.arange(1, pieces) * len(data) // pieces).clip(max=count - 1)], [len(data)]])
    )
    parts = []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        order, before = shard_transform(codes[lo:hi], ends[lo:hi] - lo, begin[lo:hi] - lo, stride, depth)
        parts.append((order + lo, before))
    if len(parts) == 1:
        parts.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
    while len(parts) > 1:  # rounds of merges in pairs
        pairs = [parts[k : k + 2] for k in range(0, len(parts), 2)]
        parts = [merged(*x, depth) if len(x) == 2 else x[0] for x in pairs]
        common = parts[0][2]
        parts = [x[:2] for x in parts]
    place = parts[0][0]
    whole = place + length <= ends[place]
    same = (common >= depth) & whole
    same[1:] &= whole[:-1]
    label = np.empty(len(data), np.int64)
    label[place] = np.cumsum(~same)
    return label[np.arange(len(data)) + length <= ends]


def remove_repeated_bytes(docs: DataFrame, *, length: int = LENGTH, hot: int = HOT, bits: int = 64) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (int64 pairs of byte offsets)."""
    if length % STRIDE:
        raise ValueError(f"length must be a multiple of {STRIDE}")
    return without_repeats(docs, Bytes(length, bits), lambda t: classes(t, length), hot).withColumnRenamed("n_units", "n_bytes")


def op4_suffix_array_dedup(spark, sf_dir):
    return remove_repeated_bytes(table(spark, sf_dir, "documents")).drop("removed")
