"""Quality rules: repetition coverage by rolling hashes of several n-gram lengths.

Texts are taken in blocks as one byte array. Words get exact ids (a dictionary of the block), n-grams of
words get rolling hashes in numpy, and one sort per length finds the n-grams that occur twice or more in
their own text. For 2 to 4 words the share of word characters in the most covering n-gram counts, for 5 to
10 words the share inside any duplicated n-gram, and for lines the share of characters in repeated ones.
Equal hashes next to each other are compared word by word; should two n-grams of a block share a hash, that
length is counted by exact codes instead.

Cases: a null or wordless text has no words, counts 0 and is rejected (under ``min_words``); very long
texts are blocks of their own; ties and repeated rows are independent rows; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafpress.llm.shared import WORD_BYTES, Runs, Texts, blocks, byte_set, map_rows, mix, rolling, same_windows, table, window_codes

SYMBOLS = byte_set(b"#*$%&|<>")
BASE = 0x9E3779B97F4A7C15
#: Bytes of texts measured at once: some twenty arrays of as many places are held beside them.
HELD_BYTES = 1 << 19


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    repeat_words_percent: int = 50
    #: Share of word characters that the most covering n-gram may take.
    top: dict[int, float] = field(default_factory=lambda: {2: 0.20, 3: 0.18, 4: 0.16})
    #: Share of word characters inside n-grams that occur twice or more.
    duplicated: dict[int, float] = field(default_factory=lambda: {5: 0.50, 6: 0.49, 7: 0.48, 8: 0.47, 9: 0.46, 10: 0.45})
    line_chars: float = 0.50
    lines: float = 0.50


def duplicated(keys: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (text, key), and for each place in that order whether it equals the one before."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    hashed = mix(keys.astype(np.uint64) ^ mix(text_of.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(hashed)
    same = (keys[order][1:] == keys[order][:-1]) & (text_of[order][1:] == text_of[order][:-1])
    if np.any(~same & (hashed[order][1:] == hashed[order][:-1])):  # two share a hash
        order = np.lexsort((keys, text_of))
        same = (keys[order][1:] == keys[order][:-1]) & (text_of[order][1:] == text_of[order][:-1])
    return order, np.concatenate([[False], same])


def both(same: np.ndarray) -> np.ndarray:
    """From 'equals the one before' to 'has an equal'."""
    out = same.copy()
    out[:-1] |= same[1:]
    return out


def per_text(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def measure(texts: Texts, limits: Limits) -> dict[str, np.ndarray]:
    data, offsets = texts.data, texts.offsets
    runs = Runs(texts, WORD_BYTES[data])
    points = (data & 0xC0) != 0x80  # the first byte of each code point
    out = {"n_words": np.diff(runs.first)}
    out["word_chars"] = per_text(offsets, points & runs.inside)
    out["n_symbols"] = per_text(offsets, SYMBOLS[data])
    chars_before = np.concatenate([[0], np.cumsum(points)])
    word_chars = chars_before[runs.ends] - chars_before[runs.starts]
    # lines: split at \n, exact ids of whole lines, those with a word only
    line = Runs(texts, data != 10)
    words_before = np.concatenate([[0], np.cumsum(runs.inside)])
    with_word = words_before[line.ends] > words_before[line.starts]
    ids, _ = line.encode(data)
    order, same = duplicated(ids[with_word].astype(np.uint64), line.text_of[with_word])
    repeat = np.zeros(int(with_word.sum()), bool)
    repeat[order[same]] = True
    full_lines = np.zeros(len(line), bool)
    full_lines[np.flatnonzero(with_word)[repeat]] = True
    out["n_dup_lines"] = per_text(line.first, full_lines)
    n_lines = per_text(line.first, with_word)
    dup_line_chars = per_text(line.first, np.where(full_lines, chars_before[line.ends] - chars_before[line.starts], 0))
    line_chars = per_text(line.first, np.where(with_word, chars_before[line.ends] - chars_before[line.starts], 0))
    # n-grams
    word_ids, _ = runs.encode(data)
    symbols, n = mix(word_ids.astype(np.uint64) + np.uint64(1)), len(runs)
    chars_to = np.concatenate([[0], np.cumsum(word_chars)])
    total = np.maximum(out["word_chars"], 1)
    over = np.zeros(len(texts), bool)
    worst = np.zeros(len(texts))
    out["n_repeat_words"] = np.zeros(len(texts), np.int64)
    for size in sorted({3, *limits.top, *limits.duplicated}):
        at = np.flatnonzero(runs.text_of[: n - size + 1] == runs.text_of[size - 1 :]) if n >= size else np.zeros(0, np.int64)
        if not len(at):
            continue
        keys, where = rolling(symbols, size, BASE)[at], runs.text_of[at]
        order, same = duplicated(keys, where)
        again = np.flatnonzero(same)
        if not same_windows(word_ids, at[order[again]], at[order[again - 1]], size).all():
            order, same = duplicated(window_codes(word_ids, size)[at], where)
        inside = both(same)
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, at[order[inside]], 1)
        np.add.at(cover, at[order[inside]] + size, -1)
        covered = np.cumsum(cover[:-1]) > 0
        if size == 3:
            out["n_repeat_words"] = per_text(runs.first, covered)
        if size in limits.duplicated:
            share = per_text(runs.first, np.where(covered, word_chars, 0)) / total
            worst = np.maximum(worst, share / limits.duplicated[size])
        if size in limits.top and same.any():
            group = np.cumsum(~same) - 1
            weight = np.bincount(group, chars_to[at[order] + size] - chars_to[at[order]])
            weight[np.bincount(group) < 2] = 0
            heaviest = np.zeros(len(texts))
            np.maximum.at(heaviest, where[order][~same], weight)
            worst = np.maximum(worst, heaviest / total / limits.top[size])
    over |= worst > 1
    over |= (n_lines > 1) & (out["n_dup_lines"] > limits.lines * n_lines)
    over |= dup_line_chars > limits.line_chars * np.maximum(line_chars, 1)
    words, repeated = out["n_words"], out["n_repeat_words"]
    out["base_failed"] = (words < limits.min_words) | (100 * repeated > limits.repeat_words_percent * words)
    out["kept"] = ~out["base_failed"] & ~over
    out["coverage"] = worst
    return out


FIELDS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean",
    "kept": "boolean", "coverage": "double"
}


def quality(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Per row: doc_id, the counts, ``base_failed``, ``kept`` and ``coverage`` (largest share over its limit)."""
    limits = limits or Limits()

    def run(batches):
        for b in batches:
            parts = [measure(t, limits) for t in blocks(b.column(1), HELD_BYTES)]
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *(pa.array(np.concatenate([p[k] for p in parts])) for k in FIELDS)], ["doc_id", *FIELDS]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{k} {v}" for k, v in FIELDS.items()))


def filter_quality(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is kept; each batch is judged as it passes, without a shuffle.

    Rows with a null or wordless text go (too few words); repeated rows are judged alike; an empty table stays empty.
    """
    limits = limits or Limits()
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            kept = [measure(t, limits)["kept"] for t in blocks(b.column(at), HELD_BYTES)]
            if kept:
                yield b.filter(pa.array(np.concatenate(kept)))

    return map_rows(docs, run)


def op3_quality_rules(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents")).withColumn("coverage", F.round("coverage", 6))
