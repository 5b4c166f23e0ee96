"""SimHash near-duplicates: fingerprints, a binary-trie self-join, connected components.

``fingerprints``: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of three words with repeats,
XXH64 with seed 42 of each; a bit is 1 if it is set in over half of the hashes.

``links``: fingerprints at ``budget`` or fewer differing bits. Of budget + 1 equal fields at least one
agrees, so each distinct fingerprint goes to the bucket of each of its fields; a bucket with very many
is dealt again by equal fields of the remaining bits, up to ``DEALS`` times. In a bucket the sorted fingerprints are an implicit
binary trie (a node is a range of them): pairs of nodes are traversed together, level by level, differing
bits are added up, and a pair over the budget is dropped. A pair of nodes that already lie in one
component is dropped too, so a bucket yields a spanning forest and never all pairs of a group.

``keep_one`` with a similarity: texts whose sets of shingles share a least hash are a bucket (``shared_minima``); the
buckets' fingerprint tries are joined in the same way at a wide budget, and of the pairs that are left each is tested
on its two sets before it links them (``similar_links``), so every link is verified. A bucket of more than ``HOT`` sets is
dealt again by other least hashes, and what is still apart in it then meets shard by shard (``rest_links``). Of pairs at similarity 0.8 one in
600 shares none of ``MINIMA`` least hashes.

``components``: alternating large-star and small-star over those links, all as joins and aggregates;
each round is written to the shared folder. Nothing is collected but the number of changes.

Cases: null, empty and wordless texts have fingerprint zero and link like any other; fewer words than a
shingle make one shingle; equal texts and repeated rows share a fingerprint and so a component; with null ids
only, a component's id is null; equal ids are told apart by nothing but their texts; a text of any length is one
fingerprint and one set, held at once; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafpress.llm.shared import BLOCK_BYTES, WORD_BYTES, Runs, batches_of, blocks, by_key, cut, fresh, mix, near_keys, own_exchange, partitions, table

BITS = 64
BUDGET = 3
SHINGLE = 3
#: A bucket with more fingerprints is dealt again by fields of the remaining bits.
BUCKET = 50_000
#: Rows of whole buckets that are traversed at once.
HELD = 100_000
#: How often a bucket is dealt: after the third time its members agree in 37 of 64 bits (budget 3).
DEALS = 3
#: Least hashes of a set that make its buckets, and what sets their orders apart.
MINIMA = 4
ORDERS = tuple(0x9E3779B97F4A7C15 * k & (1 << 64) - 1 for k in range(1, MINIMA + 1))
#: A bucket with more sets is dealt again by its other least hashes.
HOT = 1_000
#: Marks the rows of a bucket with more sets, all of them.
WHOLE = -2
#: Differing bits at which fingerprints of sets of similarity 0.8 are still paired.
WIDE = 24
#: Node pairs that one step of the traversal holds.
FRONT = 200_000


def shingle_hashes(texts, shingle: int) -> tuple[list[int], np.ndarray]:
    """The hashes of all shingles of a block of texts, one text after another, and how many each has."""
    runs = Runs(texts, WORD_BYTES[texts.data])
    first, hashes, count = runs.first, [], np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(len(texts)):
        words = texts.raw(i).lower().split()
        n = len(words)
        assert n == first[i + 1] - first[i]
        if not n:
            continue
        if n <= shingle:
            own = [digest(b" ".join(words), 42)]
        else:
            line = b" ".join(words)
            ends = np.cumsum(runs.ends[first[i] : first[i + 1]] - runs.starts[first[i] : first[i + 1]] + 1)
            begins = [0, *ends[: n - shingle].tolist()]
            own = [digest(line[a:b], 42) for a, b in zip(begins, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
        count[i] = len(own)
        hashes.extend(own)
    return hashes, count


def simhash_block(texts, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprints of a block of texts."""
    return simhash(*shingle_hashes(texts, shingle))


def simhash(hashes: Sequence[int] | np.ndarray, count: np.ndarray) -> np.ndarray:
    """The fingerprints of texts from the hashes of their shingles."""
    out = np.zeros(len(count), np.uint64)
    has = np.flatnonzero(count)
    if len(has):
        values = np.array(hashes, np.uint64)
        at = np.concatenate([[0], np.cumsum(count[has])])
        lo = 0
        while lo < len(has):  # the bits of about a million hashes at a time
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + 500_000, side="right")) - 1)
            bits = np.unpackbits(values[at[lo] : at[hi]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, at[lo:hi] - at[lo], axis=0, dtype=np.int32)
            won = ones * 2 > (at[lo + 1 : hi + 1] - at[lo:hi])[:, None]
            out[has[lo:hi]] = np.packbits(won, axis=1, bitorder="little").view(np.uint64).reshape(-1)
            lo = hi
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches):
        for b in batches:
            fps = [simhash_block(t, shingle) for t in blocks(b.column(1))]
            fps = np.concatenate(fps) if fps else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


class Forest:
    """Components of 0 .. n-1 as labels; ``join`` takes arrays of links and returns those that joined two components."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            above = self.up[self.up]
            if np.array_equal(above, self.up):
                return self.up
            self.up = above

    def root(self, k: int) -> int:
        while (above := self.up[k]) != k:
            k = above
        return int(k)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        kept = []
        at = np.arange(len(a))
        while len(at):
            roots = self.roots()
            x, y = roots[a[at]], roots[b[at]]
            differ = x != y
            at, x, y = at[differ], x[differ], y[differ]
            if not len(at):
                break
            high, low = np.maximum(x, y), np.minimum(x, y)
            order = np.lexsort((low, high))  # each root hangs below one smaller root at most
            take = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]
            self.up[high[take]] = low[take]
            kept.append(at[take])
        return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def trie_links(
    fps: np.ndarray, bounds: np.ndarray | None = None, budget: int = BUDGET, front: int = FRONT,
    test: Callable[[int, int], bool] | None = None, known: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Links (indices) that span the components of all pairs within ``budget`` bits of a bucket, and that pass ``test`` if there is one.

    A bucket's fingerprints lie between two ``bounds``, sorted, and distinct if there is no test; all buckets are traversed
    at once. Those with one label in ``known`` are one component from the start.
    """
    bounds = np.array([0, len(fps)]) if bounds is None else bounds
    forest, out = Forest(len(fps)), []
    if known is not None and len(fps):
        _, first, own = np.unique(known, return_index=True, return_inverse=True)
        forest.up = first[own]
    none = np.zeros(0, np.int64)
    lo, hi = bounds[:-1], bounds[1:]
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    if not len(lo):
        return none, none
    # a stack of (level, left lo, left hi, right lo, right hi, bits that differ); a node and itself is a pair too
    stack = [(BITS - 1, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while stack:
        level, al, ah, bl, bh, d = stack.pop()
        if len(al) > front:
            for k in range(0, len(al), front):
                stack.append((level, *(x[k : k + front] for x in (al, ah, bl, bh, d))))
            continue
        roots = forest.roots()
        changes = np.concatenate([[0], np.cumsum(roots[1:] != roots[:-1])])
        one = (changes[ah - 1] == changes[al]) & (changes[bh - 1] == changes[bl]) & (roots[al] == roots[bl])
        al, ah, bl, bh, d = (x[~one] for x in (al, ah, bl, bh, d))
        if not len(al):
            continue
        if level < 0 and test:
            for span in zip(al.tolist(), ah.tolist(), bl.tolist(), bh.tolist(), strict=True):
                for a, b in itertools.product(range(*span[:2]), range(*span[2:])):  # equal fingerprints are one leaf
                    x, y = forest.root(a), forest.root(b)
                    if x != y and test(a, b):
                        forest.up[max(x, y)] = min(x, y)
                        out.append((np.array([a]), np.array([b])))
            continue
        if level < 0:
            made = forest.join(al, bl)
            out.append((al[made], bl[made]))
            continue
        bit = np.uint64(level)
        side = np.concatenate([[0], np.cumsum((fps >> bit) & np.uint64(1))]).astype(np.int64)
        am, bm = ah - (side[ah] - side[al]), bh - (side[bh] - side[bl])  # sorted: zeros of the bit come first
        same = (al == bl) & (ah == bh)
        parts = []
        for lo1, hi1, lo2, hi2, cost, ok in (
            (al, am, bl, bm, d, None),
            (am, ah, bm, bh, d, None),
            (al, am, bm, bh, d + 1, None),
            (am, ah, bl, bm, d + 1, ~same),
        ):
            keep = (hi1 > lo1) & (hi2 > lo2) & (cost <= budget) & ~((lo1 == lo2) & (hi1 == hi2) & (hi1 - lo1 == 1))
            if ok is not None:
                keep &= ok
            parts.append([x[keep] for x in (lo1, hi1, lo2, hi2, cost)])
        stack.append((level - 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))
    return (np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])) if out else (none, none)


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def masks(fixed: int, budget: int) -> list[int]:
    """``fixed`` with one more of budget + 1 fields of the bits that it leaves: within the budget some field agrees."""
    rest = [b for b in range(BITS) if not fixed >> b & 1]
    at = [len(rest) * i // (budget + 1) for i in range(budget + 2)]
    return [fixed | sum(1 << b for b in rest[lo:hi]) for lo, hi in zip(at, at[1:], strict=False)]


def dealt(fps: DataFrame, budget: int, bucket: int) -> DataFrame:
    """(mask, v, fp): the buckets of each fingerprint, v being its bits under the mask."""
    under = lambda m: F.struct(m.alias("mask"), F.col("fp").bitwiseAND(m).alias("v"))
    known = masks(0, budget)
    rows = fps.select("fp", F.inline(F.array(*[under(F.lit(signed(m))) for m in known])))
    out = None
    for deal in range(1, DEALS + 1):
        last = deal == DEALS
        many = None if last else cut(rows.groupBy("mask", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).drop("n"))
        if last or many.isEmpty():
            return rows if out is None else out.unionByName(rows)
        few = rows.join(many, ["mask", "v"], "left_anti")
        out = few if out is None else out.unionByName(few)
        finer = {m: masks(m, budget) for m in known}
        of = F.create_map(*[x for m, own in finer.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(y)) for y in own]))])
        hot = rows.join(many, ["mask", "v"], "left_semi").select("fp", F.explode(of[F.col("mask")]).alias("mask"))
        rows = hot.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("v"))
        known = sorted({y for own in finer.values() for y in own})


def links(fps: DataFrame, budget: int = BUDGET, bucket: int = BUCKET) -> DataFrame:
    """(a, b) over distinct ``fp``: a forest that spans the components of all pairs within ``budget`` bits."""
    buckets = by_key(dealt(fps, budget, bucket).select("mask", "v", "fp"), "mask", "v").sortWithinPartitions("mask", "v")

    def run(batches):
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size < HELD:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            new = starts(rows)
            if len(new):  # the last bucket may go on
                yield from pairs(rows.column("fp").to_numpy()[: new[-1]], np.concatenate([[0], new]))
                rows = rows.slice(int(new[-1]))
            held, size = rows.to_batches(), rows.num_rows if len(new) else 0
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield from pairs(rows.column("fp").to_numpy(), np.concatenate([[0], starts(rows), [rows.num_rows]]))

    def starts(rows):
        return np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in (rows.column(c).to_numpy() for c in ("mask", "v"))])) + 1

    def pairs(fp, bounds):
        fp = fp.view(np.uint64)
        fp = fp[np.lexsort((fp, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))))]
        a, b = trie_links(fp, bounds, budget)
        for k in range(0, len(a), HELD):
            yield pa.RecordBatch.from_arrays([pa.array(fp[x[k : k + HELD]].view(np.int64)) for x in (a, b)], ["a", "b"])

    return buckets.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): root is the least node of its component.

    Large-star hangs each node's larger neighbours below its least neighbour, small-star does so with
    the smaller ones, until nothing changes; the number of rounds is logarithmic. A hub's neighbours are never
    gathered: both stars are an aggregate and a join of plain shuffles on the node (``own_exchange``).
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = now = None
    while before is None or before != now:
        before = now or ()
        both = edges.union(edges.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(own_exchange(least, "a"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(own_exchange(least, "a"), "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = cut(small.where("a <> b").distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def grouped(marked: DataFrame, budget: int, bucket: int) -> DataFrame:
    """Each ``fp`` of ``marked`` (doc_id, fp) once, with its component's ``root`` and least doc_id (component_id)."""
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp"), budget, bucket))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(own_exchange(of_root, "root"), "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, budget: int = BUDGET, bucket: int = BUCKET) -> DataFrame:
    """Every row's doc_id, fingerprint (16 hex digits) and component_id (the least doc_id that links reach)."""
    marked = cut(fingerprints(docs, shingle))
    classes = grouped(marked, budget, bucket).select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp, code, minima): of each text's set of shingles the fingerprint, a digest, and ``MINIMA`` least hashes under own orders."""

    def run(batches):
        for b in batches:
            for block in blocks(b.column(1)):
                hashes, count = shingle_hashes(block, shingle)
                values, at = np.array(hashes, np.uint64), np.concatenate([[0], np.cumsum(count)])
                sets = [np.unique(values[lo:hi]) for lo, hi in zip(at, at[1:], strict=False)]
                fps = simhash(np.concatenate(sets), np.array([len(x) for x in sets]))
                least, has = np.zeros((len(sets), MINIMA), np.int64), count > 0
                for k, seed in enumerate(ORDERS if len(values) else ()):
                    least[has, k] = np.minimum.reduceat(mix(values ^ np.uint64(seed)), at[:-1][has]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(int(block.rows[0]), len(block)), pa.array(fps.view(np.int64)),
                        pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array(least.tolist(), pa.list_(pa.int64()))
                    ],
                    ["doc_id", "fp", "code", "minima"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long, code binary, minima array<long>")


def shared_minima(sets: DataFrame, hot: int) -> DataFrame:
    """(a, b, c, d, code, fp): the buckets of ``sets`` (code, fp, minima) with two sets or more.

    A bucket is a least hash (its order a, its value c, b = -1). One of more than ``hot`` sets is dealt again by each of
    the other least hashes (b, d), which links most of what is alike in it; its rows are kept with b = -2 too, for the
    pairs that share no other least hash (``rest_links``).
    """
    one = sets.select("code", "fp", "minima", F.posexplode("minima").alias("a", "c"))
    sizes = cut(one.groupBy("a", "c").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    some = one.join(own_exchange(sizes, "c"), ["a", "c"])
    whole = F.when(F.col("n") <= hot, -1).otherwise(WHOLE)
    every = some.select("a", whole.alias("b"), "c", F.lit(0).cast("long").alias("d"), "code", "fp")
    more = some.where(F.col("n") > hot).select("a", "c", "code", "fp", F.posexplode("minima").alias("b", "d")).where("a <> b")
    return every.unionByName(more.select("a", "b", "c", "d", "code", "fp"))


def tested_links(rows: list[tuple], bounds: list[int], similarity: float, budget: int, known: bool = False):
    """Batches (a, b) of links in whole buckets of ``rows`` (fp, code, members, root); with ``known``, rows of one root are linked already."""
    fps = np.array([x[0] for x in rows], np.int64).view(np.uint64)
    order = np.lexsort((fps, np.repeat(np.arange(len(bounds)), np.diff([*bounds, len(rows)]))))
    codes, sets = ([rows[k][i] for k in order.tolist()] for i in (1, 2))
    roots = np.array([rows[k][3].hex() for k in order.tolist()]) if known else None

    def alike(i: int, j: int) -> bool:
        x, y = len(sets[i]), len(sets[j])
        if min(x, y) < similarity * max(x, y):
            return False
        both = len(np.intersect1d(np.frombuffer(sets[i], np.uint32), np.frombuffer(sets[j], np.uint32), assume_unique=True))
        return both >= similarity * ((x + y) // 4 - both)

    a, b = trie_links(fps[order], np.array([*bounds, len(rows)]), budget, FRONT, alike, roots)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array([codes[k] for k in side.tolist()], pa.binary()) for side in (a, b)], ["a", "b"])


def similar_links(buckets: DataFrame, sets: DataFrame, similarity: float, budget: int) -> DataFrame:
    """(a, b): codes of sets whose Jaccard similarity is ``similarity`` or more, spanning the components within each bucket."""
    held = buckets.join(own_exchange(sets, "code"), "code")
    keys = ["a", "b", "c", "d"]
    dealt = held.repartition(partitions(held.sparkSession), *keys).sortWithinPartitions(*keys, "fp", "code").select(*keys, "fp", "code", "members")

    def run(batches):
        now, held, bounds, size = None, [], [], 0
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                if row[:4] != now:
                    if size >= BLOCK_BYTES:
                        yield from tested_links(held, bounds, similarity, budget)
                        held, bounds, size = [], [], 0
                    now = row[:4]
                    bounds.append(len(held))
                held.append(row[4:])
                size += len(row[6]) + 64
        if held:
            yield from tested_links(held, bounds, similarity, budget)

    return dealt.mapInArrow(run, "a binary, b binary")


def rest_links(buckets: DataFrame, sets: DataFrame, roots: DataFrame, similarity: float, budget: int, hot: int) -> DataFrame | None:
    """(a, b): the links between components (``roots``: node, root) inside the whole hot ``buckets``; None where there are none to look for.

    In each bucket the sets outside its largest component are dealt into packed shards of about ``hot`` sets, and those of
    the largest one too; each two shards of which one is outside meet in one task, where the forest begins with the known
    components. So no pair of a bucket is left out, two shards are held at once, and a bucket that is one component by
    now costs nothing. The number of pairs of shards is quadratic only in the sets outside the largest component.
    """
    spark, at = buckets.sparkSession, ["a", "c"]
    placed = buckets.join(own_exchange(roots, "node"), F.col("code") == F.col("node"), "left").select(*at, "code", "fp", F.coalesce("root", "code").alias("root"))
    counts = placed.groupBy(*at, "root").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy(*at).agg(F.max(F.struct("n", "root")).alias("m"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    largest = cut(largest.select(*at, F.col("m.root").alias("bulk")))
    if largest.isEmpty():
        return None
    held = placed.join(own_exchange(largest, "c"), at).join(own_exchange(sets, "code"), "code")
    held = cut(held.withColumn("out", (F.col("root") != F.col("bulk")).cast("int")).select(*at, "out", "fp", "code", "members", "root"))
    shards = F.greatest(F.ceil(F.count(F.lit(1)) / hot), F.ceil(F.sum(F.octet_length("members") + 64) / BLOCK_BYTES)).cast("int")
    number = held.groupBy(*at).pivot("out", [0, 1]).agg(shards).toDF(*at, "n0", "n1")
    salt = F.pmod(F.xxhash64("code"), F.when(F.col("out") == 1, F.col("n1")).otherwise(F.col("n0"))).cast("int")
    packed = held.join(own_exchange(number, "c"), at).groupBy(*at, "n0", "n1", (salt + F.col("out") * F.col("n0")).alias("shard")).agg(
        F.collect_list(F.struct("fp", "code", "members", "root")).alias("rows")
    )
    other = F.filter(F.sequence(F.lit(0), F.col("n0") + F.col("n1") - 1), lambda j: (j != F.col("shard")) & ((j >= F.col("n0")) | (F.col("shard") >= F.col("n0"))))
    keys = [*at, "lo", "hi"]
    pairs = packed.withColumn("other", F.explode(other)).select(*at, F.least("shard", "other").alias("lo"), F.greatest("shard", "other").alias("hi"), "rows")
    pairs = pairs.repartition(partitions(spark), *keys).sortWithinPartitions(*keys)

    def run(batches):
        now, held = None, []
        for b in batches:
            for *key, rows in zip(*(b.column(k) for k in range(5)), strict=True):
                key = [x.as_py() for x in key]
                if key != now:
                    if held:
                        yield from tested_links(held, [0], similarity, budget, True)
                    now, held = key, []
                held += [(x["fp"], x["code"], x["members"], x["root"]) for x in rows.as_py()]
        if held:
            yield from tested_links(held, [0], similarity, budget, True)

    with batches_of(spark, 2):  # rows are shards
        return cut(pairs.mapInArrow(run, "a binary, b binary"))


def similar_roots(buckets: DataFrame, sets: DataFrame, similarity: float, budget: int, hot: int) -> DataFrame:
    """(node, root) of the sets that have a link: components of all pairs of ``similarity`` that share a least hash, in buckets of any size."""
    found = cut(similar_links(buckets.where(F.col("b") != WHOLE), sets, similarity, budget))
    roots = components(found)
    whole = buckets.where(F.col("b") == WHOLE)
    if whole.isEmpty():
        return roots
    rest = rest_links(whole, sets, roots, similarity, budget, hot)
    return roots if rest is None or rest.isEmpty() else components(found.unionByName(rest))


def set_members(texts: DataFrame, shingle: int) -> DataFrame:
    """(code, members): the set of each text (code, text) as sorted 32-bit hashes, packed."""

    def run(batches):
        for b in batches:
            for block in blocks(b.column(1)):
                hashes, count = shingle_hashes(block, shingle)
                values, at = np.array(hashes, np.uint64), np.concatenate([[0], np.cumsum(count)])
                sets = [np.unique((values[lo:hi] >> np.uint64(32)).astype(np.uint32)).tobytes() for lo, hi in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(int(block.rows[0]), len(block)), pa.array(sets, pa.binary())], ["code", "members"])

    return texts.select("code", "text").mapInArrow(run, "code binary, members binary")


def similar_classes(docs: DataFrame, marked: DataFrame, *, shingle: int, similarity: float, budget: int, hot: int) -> DataFrame:
    """(code, root, component_id) of each set in ``marked`` (doc_id, key, fp, code, minima): its component and that one's least doc_id.

    ``docs`` (key, text) gives the texts of the sets that share a least hash with another one.
    """
    nodes = cut(
        marked.groupBy("code").agg(
            F.min("doc_id").alias("least"), F.min("key").alias("key"), F.first("fp").alias("fp"), F.first("minima").alias("minima")
        )
    )
    buckets = cut(shared_minima(nodes.select("code", "fp", "minima"), hot))
    wanted = nodes.join(buckets.select("code").distinct(), "code", "left_semi").select("key", "code")
    wanted = cut(wanted)
    texts = near_keys(docs, wanted, "key").join(wanted, "key").dropDuplicates(["code"])
    sets = cut(set_members(texts, shingle))
    roots = similar_roots(buckets, sets, similarity, budget, hot)
    placed = nodes.join(roots, nodes.code == roots.node, "left").select("code", "least", F.coalesce("root", "code").alias("root"))
    of_root = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(own_exchange(of_root, "root"), "root").select("code", "root", "component_id")


def keep_one(
    docs: DataFrame, *, shingle: int = SHINGLE, budget: int = BUDGET, bucket: int = BUCKET, similarity: float | None = None,
    hot: int = HOT
) -> DataFrame:
    """The columns of ``docs`` for one row of each group: that with the least doc_id (null last), then text (null last).

    Groups are those of ``near_duplicates``. With a ``similarity``, they are the components of texts whose sets of
    shingles have that Jaccard similarity: texts that share one of ``MINIMA`` least hashes are a bucket, whose
    fingerprints' trie is joined with itself at ``budget`` bits, and each pair that is left is tested on its sets.

    Rows are told apart by a digest of id and text, so that groups with equal or null ids each keep their own; of
    rows with the same id and text one stays. Texts are shuffled once, by that digest; the survivors are chosen by
    digests, and texts are compared only where rows of one group share the id. Columns may have any name; an empty
    table stays empty.
    """
    mine, place = fresh(docs, "__key", "__place")
    ident = F.concat(
        F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit("-")), F.lit("\n"),
        F.coalesce(F.concat(F.lit("t"), "text"), F.lit("-"))
    )
    key = F.sha2(ident, 256)
    keyed = docs.select(F.struct("doc_id", key.alias("key")).alias("doc_id"), "text")
    if similarity is None:
        marked, group = cut(fingerprints(keyed, shingle).select("doc_id.doc_id", "doc_id.key", "fp")), "fp"
        classes = grouped(marked, budget, bucket)
    else:
        marked, group = cut(sketches(keyed, shingle).select("doc_id.doc_id", "doc_id.key", "fp", "code", "minima")), "code"
        texts = docs.select(key.alias("key"), "text")
        classes = similar_classes(texts, marked, shingle=shingle, similarity=similarity, budget=budget, hot=hot)
    first = marked.join(classes, group).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("root", "key").distinct()
    chosen = cut(first.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key")))
    keys = chosen.where("n = 1").select(F.col("key").alias(mine))
    # written, so that its size is known where the texts are joined, and they are not shuffled for a few rows
    tied = cut(first.join(own_exchange(chosen.where("n > 1").select("root"), "root"), "root"))
    texts = docs.select(key.alias("key"), "text").join(tied, "key")
    least = texts.groupBy("root").agg(F.min(F.struct(F.col("text").isNull().alias("none"), "text", "key")).alias("of"))
    keys = cut(keys.unionByName(least.select(F.col("of.key").alias(mine))))
    own = docs.withColumn(mine, key)
    order = [
        own[f"`{f.name}`"] for f in docs.schema.fields if f.name not in ("doc_id", "text")
        and f.dataType.simpleString() in ("string", "int", "bigint", "double", "float", "boolean", "date", "timestamp")
    ]
    one = own.withColumn(place, F.row_number().over(W.partitionBy(mine).orderBy(*order or [F.lit(0)]))).where(F.col(place) == 1)
    return one.join(keys, mine, "left_semi").select(*[one[f"`{c}`"] for c in docs.columns])


def op9_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
