"""Substring search over an inverted index of trigrams.

``index`` gives each row a number and lists for each trigram of its lower-cased fields, in blocks of numbers,
the numbers of its rows as differences. ``find`` takes the lists of the query's trigrams, block by block: those of the
rarest trigram first, each next one leaves what it shares, and the rows that are left are verified against the fields.
A block holds at most 2 ** ``BLOCK_BITS`` numbers, so no list is one row that grows with the table. Queries of one or two letters have no
trigram; they scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafpress import scratch

BLOCK_BITS = 10
SIZE = 3


class Index(NamedTuple):
    """``rows``: the indexed rows with their ``number``; ``lists``: (gram, block, n, differences)."""

    rows: DataFrame
    lists: DataFrame
    fields: tuple[str, ...]


def lowered(fields: Sequence[str]) -> list[Column]:
    return [F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields]


def grams(text: Column) -> Column:
    """The trigrams of a text, with repeats."""
    places = F.when(F.length(text) >= SIZE, F.sequence(F.lit(1), F.length(text) - SIZE + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(text, i, F.lit(SIZE)))


def index(rows: DataFrame, *fields: str) -> Index:
    """An index of ``rows`` by the trigrams of their fields; numbers are given once, in the written table."""
    numbered = scratch.cut(rows.withColumn("number", F.monotonically_increasing_id()))
    every = F.array_distinct(F.concat(*[grams(f) for f in lowered(fields)]))
    each = numbered.select("number", F.explode(every).alias("gram")).withColumn("block", F.shiftright("number", BLOCK_BITS))
    own = F.array_sort(F.collect_list("number"))
    lists = each.groupBy("gram", "block").agg(own.alias("numbers"))
    first = F.array(F.get("numbers", 0))
    steps = F.zip_with(F.slice("numbers", 2, 1 << 30), F.slice("numbers", 1, F.size("numbers") - 1), lambda b, a: b - a)
    lists = lists.select("gram", "block", F.size("numbers").alias("n"), F.concat(first, F.when(F.size("numbers") > 1, steps).otherwise(F.array().cast("array<bigint>"))).alias("differences"))
    return Index(numbered, scratch.cut(lists), fields)


def numbers(differences: Column) -> Column:
    """The numbers whose differences these are."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    step = lambda acc, d: F.struct((acc["at"] + d).alias("at"), F.concat(acc["out"], F.array(acc["at"] + d)).alias("out"))
    return F.aggregate(differences, start, step, lambda acc: acc["out"])


def candidates(own: Index, query: str) -> DataFrame:
    """The rows that hold all trigrams of a lower-cased query of three letters or more."""
    wanted = sorted({query[i : i + SIZE] for i in range(len(query) - SIZE + 1)})
    lists = own.lists.where(F.col("gram").isin(*wanted))
    held = lists.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("n", "gram", "differences"))).alias("lists"))
    held = held.where(F.size("lists") == len(wanted))  # at most one list a trigram and block
    first = numbers(F.get("lists", 0)["differences"])
    both = F.aggregate(F.slice("lists", 2, len(wanted)), first, lambda left, x: F.when(F.size(left) == 0, left).otherwise(F.array_intersect(left, numbers(x["differences"]))))
    found = held.select(F.explode(both).alias("number"))
    return own.rows.join(found, "number", "left_semi")


def find(own: Index, query: str) -> DataFrame:
    """The indexed rows, one of whose fields holds the query as a literal substring, whatever the case; an empty query finds nothing."""
    q = query.strip().lower()
    hit = F.lit(False)
    for f in lowered(own.fields):
        hit |= F.contains(f, F.lit(q))
    rows = candidates(own, q) if len(q) >= SIZE else own.rows
    return rows.where(hit if q else F.lit(False)).drop("number")
