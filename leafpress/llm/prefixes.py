"""Prefix trie of conversations: chained digests, one group a node, sums over subtrees.

A turn is known by the SHA-256 of its role and text, made before anything is shuffled, so texts never travel.
``chained`` streams over the turns of each conversation in order and chains these digests: the digest of the
first d turns is that of the digest of d - 1 turns and the d-th turn. Every prefix is then a row, and the rows
that agree in (depth, digest) are a node.

Subtrees: each node belongs to its smallest member, whose own prefixes are the node's ancestors. The nodes of
one member are the ends of its chain (members of a node are members of all nodes above), so exploding each of
them to all its ancestors and adding up what reaches an ancestor is one running sum along the chain, from its
end to the root. It is made before the shuffle to the ancestors: a conversation of n turns sends n + 1 rows up,
not n * (n + 1) / 2.

Hot nodes: counts, sums and least members are combined before each shuffle. The members that end at a node
are packed by ranges of 2 ** ``PACK_BITS`` ids into strings, and their digest streams over those in order. Joins with a
node's parent are of plain shuffles, so a parent with very many children can be split. One conversation is one
sequence: its turns (digests and counts, no texts) stream through one task in constant memory.

Cases: null role and null text are empty; a null turn comes first, equal turns go by role, then by the digest
of role and text; repeated rows are turns of their own; rows without a conv_id belong to no conversation; an
empty turn (role and text empty) is a turn; a conversation named in ``ids`` without turns is a member of the
root; without any conversation there is no node; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafpress.llm.shared import by_key, cut, own_exchange, table

WORD = r"[^\x20\x09-\x0D]+"
#: Ids that agree but for so many bits are packed into a string before the digest of members is made.
PACK_BITS = 10
#: How conversations are rebuilt by ``rebuilt``: groups of so many ids share the first turns of their first one, up to ``HEADS`` - 1 of them.
SHARING, HEADS = 20, 4


def known(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, own, words): each turn by its digest, with the number of words of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    return turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), own.alias("own"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )


def numbered(turns: DataFrame) -> DataFrame:
    """The turns with their place ``at`` in the conversation, from 1."""
    order = [F.col("turn").asc_nulls_first(), "role", "own"]
    return turns.withColumn("at", F.row_number().over(W.partitionBy("conv_id").orderBy(*order)).cast("long"))


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, at, own, words) and the ids: the first h turns of each group's first conversation, then the own ones after h.

    h is the CRC-32 of the decimal id, modulo ``HEADS``. ``placed`` comes from ``numbered``.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    ids = placed.select("conv_id").distinct()
    heads = placed.where((F.col("at") < HEADS) & (F.col("conv_id") % SHARING == 0))
    heads = heads.select(F.col("conv_id").alias("first"), "at", "own", "words")
    taken = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % SHARING).alias("first"), h.alias("h"))
    taken = taken.join(heads, "first").where("at <= h").select("conv_id", "at", "own", "words")
    return placed.where(F.col("at") > h).select("conv_id", "at", "own", "words").unionByName(taken), ids


def chained(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, above, words, ends): every prefix of every conversation, the empty one included.

    ``turns`` has conv_id, at, own and words; ``above`` is the digest of one turn less (null at the root), ``ends``
    is 1 for the whole conversation.
    """
    starts = ids.select("conv_id", F.lit(0).cast("long").alias("at"), F.lit(None).cast("binary").alias("own"), F.lit(0).cast("long").alias("words"))
    dealt = by_key(turns.select("conv_id", "at", "own", "words").unionByName(starts), "conv_id").sortWithinPartitions("conv_id", "at")

    def run(batches):
        held = None  # the prefix before; whether it is the last is known with the next row
        for b in batches:
            out = []
            for conv, own, words in zip(*(b.column(c).to_pylist() for c in ("conv_id", "own", "words")), strict=True):
                if held is not None:
                    out.append((*held, int(conv != held[0])))
                if own is None:
                    held = (conv, 0, hashlib.sha256().digest(), None, 0)
                else:
                    held = (conv, held[1] + 1, hashlib.sha256(held[2] + own).digest(), held[2], words)
            yield rows(out)
        if held is not None:
            yield rows([(*held, 1)])

    def rows(out):
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        names = ["conv_id", "depth", "digest", "above", "words", "ends"]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names)

    return dealt.mapInArrow(run, "conv_id long, depth long, digest binary, above binary, words long, ends long")


def ending(prefixes: DataFrame) -> DataFrame:
    """(depth, digest, ends_sha256): the digest of the ids that end at a node, in ascending order, comma-joined."""
    own = prefixes.where("ends = 1").groupBy("depth", "digest", F.shiftright("conv_id", PACK_BITS).alias("range"))
    packed = own.agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    dealt = by_key(packed, "depth", "digest").sortWithinPartitions("depth", "digest", "range")

    def run(batches):
        now, digest = None, None
        for b in batches:
            out = []
            for depth, key, ids in zip(*(b.column(c).to_pylist() for c in ("depth", "digest", "ids")), strict=True):
                if now != (depth, key):
                    if now is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest = (depth, key), hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
            yield rows(out)
        if now is not None:
            yield rows([(*now, digest.hexdigest())])

    def rows(out):
        return pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.string()))], ["depth", "digest", "ends_sha256"]
        )

    return dealt.mapInArrow(run, "depth long, digest binary, ends_sha256 string")


def trie(prefixes: DataFrame) -> DataFrame:
    """The nodes of ``prefixes`` (a table of ``chained``): see ``prefix_trie``."""
    nodes = prefixes.groupBy("depth", "digest").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("ends").alias("ending"), F.min("words").alias("words"),
        F.min("above").alias("above")
    )
    nodes = cut(nodes)
    # along each chain: its prefixes, and the nodes that it owns with what they add to all above
    saved, leaf = (F.col("n_convs") - 1) * F.col("words"), (F.col("n_convs") == F.col("ending")).cast("long")
    none = F.lit(None).cast("long")
    owned = nodes.select("conv_id", "depth", F.lit(None).cast("binary").alias("digest"), saved.alias("saved"), leaf.alias("leaf"))
    along = prefixes.select("conv_id", "depth", "digest", none.alias("saved"), none.alias("leaf")).unionByName(owned)
    chain = W.partitionBy("conv_id").orderBy((-F.col("depth")).alias("up"))
    from_end, one_below = chain.rangeBetween(W.unboundedPreceding, 0), chain.rangeBetween(-1, -1)
    along = along.withColumns(
        {"saved": F.sum("saved").over(from_end), "leaves": F.sum("leaf").over(from_end), "children": F.count("leaf").over(one_below)}
    ).where("digest IS NOT NULL AND leaves IS NOT NULL")
    sums = along.groupBy("depth", "digest").agg(
        F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")
    )
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(sums, ["depth", "digest"]).join(ending(prefixes), ["depth", "digest"], "left")
        .join(own_exchange(parents, "depth"), ["depth", "above"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), F.hex("digest").alias("digest")
        )
    )


def prefix_trie(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text), one row a node.

    conv_id: smallest member; depth; parent_conv_id: that of the node above (root: null); n_convs: members;
    n_children; n_leaves: nodes without children in the subtree, itself included; saved_tokens: over the subtree,
    each node's members but one times the words of its last text; ends_sha256: of the members that end here;
    digest: hexadecimal. ``ids`` (conv_id) names all conversations, where some may have no turn.
    """
    placed = numbered(known(conversations))
    every = placed.select("conv_id")
    if ids is not None:
        every = every.unionByName(ids.select(F.col("conv_id").cast("long").alias("conv_id")).where("conv_id IS NOT NULL"))
    return trie(cut(chained(placed, every.distinct())))


def op12_conversation_trie(spark, sf_dir):
    placed = cut(numbered(known(table(spark, sf_dir, "conversations"))))
    return trie(cut(chained(*rebuilt(placed)))).drop("digest")
