"""License scans by diagonal voting, with DataFrame functions only.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. Every run of ``ROLL`` words of every text is
hashed and joined to the runs of the templates (a table as large as ``templates``, no larger with the corpus). A hit
at word p of the text and word t of the template votes for the diagonal p - t. Diagonals at most ``DRIFT`` apart are
merged, so words put in or left out don't end a span. A merged span is verified word by word: the share of the
template's words that stand at their place on one of its diagonals, ``LEAST`` or more, gives the template's label.

Hits are known by the SHA-256 of their text, so a text with many copies is voted for and verified once: votes are sets
of places, combined before they are shuffled, and texts are fetched only for keys with hits, one copy each
(``shared.near_keys`` keeps nearly all others from the shuffle, up to some million texts with hits).
Spans of one text are an array that its length bounds. The join back to the rows is of plain shuffles, so a text
with very many copies can be split.

Base labels come from phrases: places where a phrase's words stand one after another.

Cases: null, empty and wordless texts have no words, no labels and score 0; a text shorter than a run has no hits, but
phrases count; rows with equal or null ids and repeated rows are rows of their own; equal scores: no choice is made,
all labels stay; an empty table gives an empty result; no templates or no phrases are allowed; a template of fewer
words than a run is an error; other columns are not read, whatever their names. A row's words are held at once, as
an array of Spark's.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafpress.llm.shared import cut, near_keys, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words, before A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROLL = 4
DRIFT = 3
LEAST = 0.7
#: Phrases and the labels they give.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices as licenses and their stewards publish them, and short forms of them.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0."),
    (
        "apache",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer."
    ),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies."
    ),
    ("mit", "Released under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
        "merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


def words(text: str) -> list[str]:
    """The words of one text."""
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def spaced(text: Column) -> Column:
    """The words of a text, as they are, with one space between them: far cheaper than to extract them one by one."""
    return F.trim(F.regexp_replace(text, F.lit(BETWEEN), F.lit(" ")))


def split_words(text: Column) -> Column:
    """The words of a text, as they are."""
    return F.array_remove(F.split(spaced(text), " "), "")


def words_of(text: Column) -> Column:
    """The words of a text; of all letters only A-Z are lower-cased, which takes time for each letter."""
    return split_words(F.translate(text, UPPER, LOWER))


def starts(n: Column, length: int) -> Column:
    """Places 0, 1, ... of the runs of ``length`` among ``n`` words."""
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


def runs(hashed: Column, roll: int) -> Column:
    """Hashes of all runs of ``roll`` words, from the words' hashes."""
    return F.transform(starts(F.size(hashed), roll), lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(roll)]))


def runs_of(rows: DataFrame, roll: int) -> DataFrame:
    """``rows`` with a column ``words``, exploded to (the other columns, place, hash). Any case: hits are verified."""
    own = [c for c in rows.columns if c != "words"]
    hashed = rows.select(*own, F.transform("words", lambda w: F.xxhash64(F.lower(w))).alias("hashed"))
    return hashed.select(*own, F.posexplode(runs(F.col("hashed"), roll)).alias("place", "hash"))


def phrase_places(found: Column, phrases: Sequence[tuple[str, str]]) -> list[Column]:
    """For each phrase the places (from 0) where its words stand in ``found``, an array."""

    def of(own: list[str]) -> Column:
        def stands(i: Column) -> Column:
            return reduce(operator.and_, [F.get(found, i + k) == w for k, w in enumerate(own)])

        return F.filter(starts(F.size(found), len(own)), stands)

    return [of(phrase.split()) for phrase, _ in phrases]


def merged(hits: DataFrame, drift: int, roll: int) -> DataFrame:
    """(key, spans): hits (key, template, place, at) counted by diagonal, near diagonals of a template merged.

    A vote is a place of the text, so copies of it vote for the same ones.
    """
    votes = hits.groupBy("key", "template", (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.size(F.collect_set("place")).alias("votes"), F.min("place").alias("first"), F.max("place").alias("last")
    )
    line = W.partitionBy("key", "template").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(line) > drift
    votes = votes.withColumn("new", F.coalesce(far, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(line))
    spans = votes.groupBy("key", "template", "island").agg(
        F.array_sort(F.collect_list("diagonal")).alias("diagonals"), F.sum("votes").alias("votes"), F.min("first").alias("first"),
        (F.max("last") + roll - 1).alias("last")
    )
    return spans.groupBy("key").agg(F.collect_list(F.struct("template", "diagonals", "votes", "first", "last")).alias("spans"))


def license_spans(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, *, roll: int = ROLL, drift: int = DRIFT, least: float = LEAST
) -> DataFrame:
    """(key, spans) of the distinct texts of ``docs`` (key, text: the same key, the same text) that have verified spans.

    A span has its label, the template's number, its first and last word in the text, its votes, and as ``share`` the
    part of the template's words that stand at their place on one of the span's diagonals.
    """
    known = [words(text) for _, text in templates]
    if any(len(w) < roll for w in known):
        raise ValueError(f"a template has fewer than {roll} words")
    rows = docs.sparkSession.createDataFrame(list(enumerate(known)), "template int, words array<string>")
    theirs = runs_of(rows, roll).select("hash", "template", F.col("place").alias("at"))
    ours = runs_of(docs.select("key", split_words(F.col("text")).alias("words")), roll)
    hits = ours.join(F.broadcast(theirs), "hash").select("key", "template", "place", "at")  # as large as the templates
    found = cut(merged(hits, drift, roll))
    texts = near_keys(docs.select("key", "text"), found, "key").groupBy("key").agg(F.first("text").alias("text"))
    held = texts.join(found, "key")
    own_words = F.array(*[F.array(*map(F.lit, w)) for w in known]) if known else F.array().cast("array<array<string>>")
    labels = F.array(*[F.lit(label) for label, _ in templates]) if known else F.array().cast("array<string>")

    def verified(words: Column, span: Column) -> Column:
        own = F.get(own_words, span["template"])

        def stands(at: Column) -> Column:
            return F.exists(span["diagonals"], lambda d: F.coalesce(F.get(words, d + at) == F.get(own, at), F.lit(False)))

        share = F.size(F.filter(F.sequence(F.lit(0), F.size(own) - 1), stands)) / F.size(own)
        return F.struct(
            F.get(labels, span["template"]).alias("label"), span["template"].alias("template"), span["first"].alias("first"),
            span["last"].alias("last"), span["votes"].alias("votes"), share.alias("share")
        )

    # the words of a text are bound by a lambda, so they are made once, not for each word that is compared
    spans = F.flatten(F.transform(F.array(words_of(F.col("text"))), lambda w: F.transform("spans", lambda x: verified(w, x))))
    return held.select("key", F.filter(spans, lambda x: x["share"] >= least).alias("spans")).where(F.size("spans") > 0)


def scan_licenses(
    docs: DataFrame, *, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, roll: int = ROLL,
    drift: int = DRIFT, least: float = LEAST
) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its licenses.

    n_words; n_base: places of phrases, first_word and last_word their least and greatest start (null without one);
    base_labels and labels: those of phrases, and all, distinct, sorted, comma-joined; score: the greatest share of a
    template that a verified span covers, 0 without one; spans: the verified spans, in order of their places.
    """
    keyed = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = keyed.withColumn("key", F.unhex(F.sha2("text", 256)))
    found = cut(license_spans(keyed, templates, roll=roll, drift=drift, least=least))
    # only texts that hold the last word of a phrase, in any case, are searched for the phrase
    ends = "|".join(sorted({re.escape(phrase.split()[-1]) for phrase, _ in phrases}))
    may = F.regexp_like("text", F.lit(f"(?i){ends}")) if phrases else F.lit(False)
    none = F.array().cast("array<array<int>>")
    base = keyed.select("doc_id", "key", spaced(F.col("text")).alias("said"), F.when(may, words_of(F.col("text"))).alias("own"))
    gaps = F.length("said") - F.length(F.replace("said", F.lit(" "), F.lit("")))
    base = base.select("doc_id", "key", "own", F.when(F.col("said") == "", 0).otherwise(gaps + 1).cast("long").alias("n_words"))
    places = F.array(*phrase_places(F.col("own"), phrases)) if phrases else none
    base = base.select("doc_id", "key", "n_words", F.when(F.col("own").isNotNull(), places).otherwise(none).alias("places"))
    labels = F.array(*[F.lit(label) for _, label in phrases]) if phrases else F.array().cast("array<string>")
    every = F.flatten("places")
    base = base.select(
        "doc_id", "key", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.filter(F.transform("places", lambda p, i: F.when(F.size(p) > 0, F.get(labels, i))), lambda x: x.isNotNull()).alias("base")
    )
    spans = F.coalesce("spans", F.array().cast(found.schema["spans"].dataType))
    more = F.transform(spans, lambda x: x["label"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return base.join(found, "key", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", more)).alias("labels"), F.coalesce(F.array_max(F.transform(spans, lambda x: x["share"])), F.lit(0.0)).alias("score"),
        F.array_sort(F.transform(spans, lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), x["label"].alias("label"), x["share"].alias("share")))).alias("spans")
    )


def op11_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")
