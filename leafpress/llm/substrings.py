"""Substring dedup by super-k-mers: windows of 35 words that share a minimiser travel as one packed string to
its bucket (``superkmers``), where sorting counts the windows exactly: equal hashes next to each other are compared
word by word, and should two windows share one, exact codes take the place of all hashes.

Cases: null and wordless texts have no words; texts under 35 words keep all; equal texts of 35 words and more
are removed whole, repeated rows too; very long texts are one row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from leafpress.llm.shared import WORD_BYTES, Runs, Texts, mix, rolling, same_windows, table, window_codes
from leafpress.llm.superkmers import HOT, Words, without_repeats

LENGTH = 35
BASE_A = 0xC2B2AE3D27D4EB4F


def classes(texts: Texts, length: int = LENGTH) -> np.ndarray:
    """A label of each window of each string, one after another: equal labels, equal words."""
    runs = Runs(texts, WORD_BYTES[texts.data])
    ids, _ = runs.encode(texts.data)
    n = len(ids) - length + 1
    at = np.flatnonzero(np.arange(n) + length <= runs.first[runs.text_of[:n] + 1]) if n > 0 else np.zeros(0, np.int64)
    if not len(at):
        return at
    keys = mix(rolling(mix(ids.astype(np.uint64) + np.uint64(1)), length, BASE_A))[at]
    order = np.argsort(keys)
    again = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    if not same_windows(ids, at[order[again]], at[order[again + 1]], length).all():  # two windows share a hash
        return window_codes(ids, length)[at]
    out = np.empty(len(at), np.int64)
    out[order] = np.cumsum(np.concatenate([[False], keys[order][1:] != keys[order][:-1]]))
    return out


def remove_repeated_words(docs: DataFrame, *, length: int = LENGTH, hot: int = HOT, bits: int = 64) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, n_spans, kept_sha256, removed (int64 pairs of word indices)."""
    return without_repeats(docs, Words(length, bits), lambda t: classes(t, length), hot).withColumnRenamed("n_units", "n_words")


def op5_substring_dedup(spark, sf_dir):
    return remove_repeated_words(table(spark, sf_dir, "documents")).drop("removed")
