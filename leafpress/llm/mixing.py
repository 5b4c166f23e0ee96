"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks.

The main path holds DataFrame operations only. Sources get token targets by weight, capped at ``most`` times
their size (water-filling, see ``source_targets``). Documents are dealt by a hash of their id into shards, so
that a source with a third of all rows is many shards, and shards into groups. Blocks go by highest quotients
(``apportion``) to sources, inside a source to its groups, and inside a group to its shards, so the rows that
one window orders are the sources, or at most ``GROUP`` groups or shards, whatever the size of the corpus.
(A source of more than ``GROUP`` squared shards has larger groups of shards.) Each shard then takes its quota
from its own blocks: all of them ``quota // blocks`` times, and of the rest a seeded systematic draw over a
seeded order of the documents. Selected blocks are counted in closed form for each document, so no block is
ever a row. All hashes are MD5, so that SQL can state the same mix.

Cases: a null or wordless text has size 0 and takes 0; a null source is a source, last in order; rows with a
null id are dealt by their text; equal sizes, repeated rows and repeated ids are separate rows (each may be
taken; equal ones lie in one shard); an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafpress.llm.shared import cut, table

WEIGHTS = (5, 2, 1)
MOST = 3
SHARD_ROWS = 5_000
#: Groups of a source, and shards of a group.
GROUP = 2_000
BLOCKS_PER_SHARD = 2_000
MAX_BLOCK = 1_024
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size, rows) with ``target``: shares of the total by weight, none above ``most`` times its size.

    With the sources in order of cap / weight, the first k are capped for the least k where the level
    (rest of the total over rest of the weights) stays below the next source's ratio.
    """
    place = W.orderBy(F.col("source").asc_nulls_last())
    out = sources.withColumn("n", F.row_number().over(place) - 1)
    out = out.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("n") % len(weights) + 1).cast("int")))
    out = out.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    every, before = W.partitionBy(F.lit(0)), W.partitionBy(F.lit(0)).orderBy("ratio", "n").rowsBetween(W.unboundedPreceding, -1)
    spent, weighed = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    out = out.withColumn("level", (F.sum("source_size").over(every) - spent) / (F.sum("weight").over(every) - weighed))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "n", "level"))).over(every)
    out = out.withColumn("level", first["level"])
    return out.withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("level")), F.col("cap"))).drop("cap", "ratio", "level")


def number(*parts: Column, seed: int) -> Column:
    """A long of 60 bits from the MD5 of the parts (null: empty) and a seed, joined by colons."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def apportion(units: DataFrame, share: str, key: Sequence[str], seats: str, inside: Sequence[str] = ()) -> DataFrame:
    """Add ``quota``: the Sainte-Laguë allocation of ``seats`` (equal in all rows of an ``inside``) by ``share``, ties by ``key``.

    A divisor a little above the final one gives each unit a base that the final allocation can't fall
    below; only the seats that are left (1.5 times the number of units at most) go by quotients. A unit
    can gain no more than its share of them and one more, so few quotients are made and all that matter.
    """
    every = W.partitionBy(*inside) if inside else W.partitionBy(F.lit(0))
    own = [c for c in (*inside, *key)]
    out = units.withColumn(share, F.col(share).cast("double"))
    out = out.withColumns({"_seats": F.col(seats).cast("long"), "_n": F.count(F.lit(1)).over(every), "_all": F.sum(share).over(every)})
    loose = F.col("_seats") - F.col("_n")
    base = F.when((loose > 0) & (F.col("_all") > 0), F.floor(F.col(share) * loose / F.col("_all") + 0.5)).otherwise(F.lit(0))
    out = out.withColumn("_base", base.cast("long"))
    rest = F.when(F.col("_all") > 0, F.greatest(F.lit(0), F.col("_seats") - F.sum("_base").over(every))).otherwise(F.lit(0))
    out = out.withColumn("_rest", rest.cast("long"))
    gain = F.when(F.col(share) > 0, F.ceil(F.col(share) / F.col("_all") * (F.col("_rest") + F.col("_n"))) + 1).otherwise(F.lit(0)).cast("long")
    ks = F.when(gain > 0, F.sequence(F.lit(1).cast("long"), gain)).otherwise(F.array().cast("array<bigint>"))
    tried = out.select(*own, share, "_base", "_rest", F.explode(ks).alias("_k"))
    tried = tried.withColumn("_quotient", F.col(share) / (2 * (F.col("_base") + F.col("_k")) - 1))
    best = every.orderBy(F.col("_quotient").desc(), *[F.col(c).asc_nulls_last() for c in key], "_k")
    won = tried.withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= F.col("_rest"))
    won = won.groupBy(*own).agg(F.count(F.lit(1)).alias("_won"))
    out = out.alias("u").join(won.alias("w"), matched(own, "u", "w"), "left").select("u.*", F.col("w._won"))
    out = out.withColumn("quota", F.col("_base") + F.coalesce(F.col("_won"), F.lit(0)))
    return out.drop("_seats", "_n", "_all", "_base", "_rest", "_won")


def matched(names: Sequence[str], left: str, right: str) -> Column:
    """Equal in all ``names``, null with null."""
    out = F.lit(True)
    for c in names:
        out &= F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def drawn(to: Column, quota: Column, blocks: Column, start: Column) -> Column:
    """How many of the first ``to`` blocks a systematic draw of ``quota`` out of ``blocks`` takes, in exact integers."""
    big = lambda x: x.cast("decimal(19,0)")

    def whole(x: Column) -> Column:
        product = big(x) * big(quota)
        return ((product - F.pmod(product, big(blocks))) / big(blocks)).cast("long")

    return whole(to + start) - whole(start)


def mix(
    docs: DataFrame, *, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 7, shard_rows: int = SHARD_ROWS, group: int = GROUP
) -> DataFrame:
    """Every row of ``docs`` (doc_id, source, text) with size, source_size, target and the words ``taken`` from it."""
    # rows without an id are told apart by their text
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit("")))))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"))
    sized = cut(
        sized.select(
            "doc_id", "source", "size", number(F.col("key"), seed=seed).alias("dealt"), number(F.col("key"), seed=seed + 1).alias("place")
        )
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    sources = source_targets(sources, weights, most).withColumn("shards", F.ceil(F.col("rows") / shard_rows).cast("long"))
    sources = sources.withColumn("groups", F.least(F.lit(group), F.ceil(F.col("shards") / group)).cast("long"))
    # so many blocks to a shard that its last one, which may be a part of one, counts for little
    block = F.floor(F.col("source_size") / F.col("shards") / BLOCKS_PER_SHARD)
    sources = sources.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCK), block)).cast("long"))
    sources = sources.withColumn("share", F.col("target") / F.col("block"))
    sources = sources.withColumn("seats", F.round(F.sum("share").over(W.partitionBy(F.lit(0)))))
    sources = cut(apportion(sources, "share", ["source"], "seats").drop("share", "seats"))
    shard = F.pmod(F.col("d.dealt"), F.col("s.shards"))
    rows = sized.alias("d").join(sources.alias("s"), matched(["source"], "d", "s"))
    rows = rows.select(
        "d.doc_id", "d.source", "d.size", "d.place", "s.source_size", "s.target", shard.alias("shard"),
        F.pmod(shard, F.col("s.groups")).alias("grp")
    )
    shards = cut(rows.groupBy("source", "grp", "shard").agg(F.sum("size").alias("shard_size")))
    groups = shards.groupBy("source", "grp").agg(F.sum("shard_size").alias("group_size"))
    groups = groups.alias("g").join(
        sources.select("source", "quota", "block").alias("s"), matched(["source"], "g", "s")
    ).select("g.*", F.col("s.quota").alias("seats"), "s.block")
    groups = apportion(groups, "group_size", ["grp"], "seats", ["source"]).select("source", "grp", "block", F.col("quota").alias("seats"))
    shards = shards.alias("d").join(groups.alias("g"), matched(["source", "grp"], "d", "g")).select("d.*", "g.block", "g.seats")
    shards = apportion(shards, "shard_size", ["shard"], "seats", ["source", "grp"])
    blocks = F.greatest(F.lit(1), F.ceil(F.col("shard_size") / F.col("block"))).cast("long")
    shards = cut(shards.select("source", "shard", "block", blocks.alias("blocks"), F.least(F.col("quota"), blocks * most).alias("quota")))
    in_shard = W.partitionBy("source", "shard").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.drop("grp").withColumn("end", F.sum("size").over(in_shard))
    placed = placed.alias("r").join(shards.alias("q"), matched(["source", "shard"], "r", "q")).select("r.*", "q.block", "q.blocks", "q.quota")
    start = F.pmod(number(F.col("source"), F.col("shard"), seed=seed + 2), F.col("blocks"))
    placed = placed.withColumns({"full": F.floor(F.col("quota") / F.col("blocks")), "rest": F.col("quota") % F.col("blocks"), "start": start})
    upto = lambda c: drawn(c, F.col("rest"), F.col("blocks"), F.col("start"))

    def tokens(at: Column) -> Column:
        """Drawn tokens before position ``at`` of the shard."""
        k = F.floor(at / F.col("block"))
        return upto(k) * F.col("block") + (at % F.col("block")) * (upto(k + 1) - upto(k))

    taken = F.col("size") * F.col("full") + tokens(F.col("end")) - tokens(F.col("end") - F.col("size"))
    return placed.select(
        "doc_id", "source", "size", "source_size", "target",
        F.when(F.col("size") > 0, taken).otherwise(F.lit(0)).cast("long").alias("taken")
    )


def op10_mix_sources(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))
