"""Token counts: pieces are counted once per distinct pre-token and joined to per-document frequencies.

One pass over the texts makes a row per chunk of documents, with each document's pre-token frequencies, and
for each bucket (by hash) a row with the chunk's distinct pre-tokens there, all packed. Only those lists are
shuffled: in its bucket a pre-token is tokenised once for the whole table. The counts go back to their chunk
in the list's order, and a document's tokens are the sum of frequency times pieces. No token id is ever kept.

A chunk ends by its distinct pre-tokens, so a chunk of common words holds more text, and lists don't get shorter
with the corpus. A bucket's worker remembers its distinct pre-tokens, about 130 bytes each. There are as many
buckets as shuffle partitions, which grow with the input, up to ``MOST_BUCKETS``: then 10 billion distinct
pre-tokens are 600,000 to a bucket, or 80 MB. ``buckets`` sets another number.

A special string of the tokenizer inside a text is one token, as its library does by default. Texts with
code points where Unicode tables differ between versions are split by the tokenizer's own splitter.

Cases: a null or empty text has no bytes and no tokens; one very long text is a chunk of its own; ties and
repeated rows are separate rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import array
import functools
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafpress.llm.shared import cut, partitions, table

TOKENIZER = "byte_bpe_50k.json"
OVER = 1024
#: Where a chunk ends: bytes of text, distinct pre-tokens.
CHUNK_BYTES, CHUNK_TOKENS = 32 << 20, 200_000
#: Buckets of pre-tokens: as many as shuffle partitions, within these.
LEAST_BUCKETS, MOST_BUCKETS = 64, 16_384
#: Code points whose class (letter, number, space) the splitter's tables and this library's agree on; tested over all of Unicode.
AGREED = regex.compile(r"[\x00-՗ -⁯₠-ꟍ]*+")


@functools.lru_cache(4)
def tokenizer(path: str):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    specials = [t["content"] for t in json.loads(own.to_str())["added_tokens"]]
    apart = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None
    return own, regex.compile(public_tokenizers.PATTERN), apart


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


#: The byte-level alphabet's reverse: from its letters back to bytes.
@functools.lru_cache(1)
def letters_to_bytes() -> dict[str, int]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


def pre_tokens(text: str, path: str) -> tuple[list[str], int]:
    """The pre-tokens of a text, and how many special strings it holds."""
    own, split, apart = tokenizer(path)
    parts, n = [text], 0
    if apart is not None and apart.search(text):
        parts = apart.split(text)
        n = len(parts) - 1
    out: list[str] = []
    for part in parts:
        if AGREED.fullmatch(part):
            out += split.findall(part)
        elif part:
            back = letters_to_bytes()
            out += [bytes(map(back.__getitem__, p)).decode("utf-8", "surrogateescape") for p, _ in own.pre_tokenizer.pre_tokenize_str(part)]
    return out, n


def count_pieces(pre: list[str], path: str) -> list[int]:
    own = tokenizer(path)[0]
    own.encode_special_tokens = True
    return [len(e) for e in own.encode_batch(pre, add_special_tokens=False)]


class Chunk:
    """Documents, the pre-tokens that they hold, and how often each holds which."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.places, self.times = array.array("I"), array.array("I")
        self.ids, self.n_bytes, self.sizes, self.special = [], [], [], []

    def add(self, doc_id, text: str, n_bytes: int, path: str) -> None:
        pre, n = pre_tokens(text, path)
        counted, known = Counter(pre), self.known
        self.places.extend([known.setdefault(p, len(known)) for p in counted])
        self.times.extend(counted.values())
        self.ids.append(doc_id)
        self.n_bytes.append(n_bytes)
        self.sizes.append(len(counted))
        self.special.append(n)

    def batch(self, number: int, n_buckets: int, kind: pa.DataType) -> pa.RecordBatch:
        """One row with the documents' frequencies, and one for each bucket with the distinct pre-tokens there."""
        make = zstandard.ZstdCompressor(level=3)
        arrays = (np.frombuffer(x, np.uint32).astype(np.int64) for x in (self.places, self.times))
        packed = make.compress(pack(*arrays, np.array(self.sizes, np.int64)))
        raw = [p.encode("utf-8", "surrogateescape") for p in self.known]
        bucket = np.array([xxhash.xxh32_intdigest(r) % n_buckets for r in raw], np.uint16)
        order = np.argsort(bucket, kind="stable")
        numbers, begin = np.unique(bucket[order], return_index=True)
        lists = [
            make.compress(b"".join(len(raw[i]).to_bytes(4, "little") + raw[i] for i in order[lo:hi]))
            for lo, hi in zip(begin, [*begin[1:], len(raw)], strict=False)
        ]
        n = len(lists)
        columns = {
            "chunk": pa.array([number] * (n + 1), pa.int64()),
            "bucket": pa.array([None, *numbers.tolist()], pa.int32()),
            "packed": pa.array([packed, *lists], pa.binary()),
            "buckets": pa.array([make.compress(bucket.tobytes()), *[None] * n], pa.binary()),
            "ids": pa.array([self.ids, *[None] * n], pa.list_(kind)),
            "n_bytes": pa.array([self.n_bytes, *[None] * n], pa.list_(pa.int64())),
            "sizes": pa.array([self.sizes, *[None] * n], pa.list_(pa.int32())),
            "special": pa.array([self.special, *[None] * n], pa.list_(pa.int32())),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def token_counts(docs: DataFrame, *, path: str | None = None, over: int = OVER, buckets: int | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens and over_limit (more than ``over`` tokens)."""
    spark, path = docs.sparkSession, path or default_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    n_buckets = buckets or min(MOST_BUCKETS, partitions(spark, LEAST_BUCKETS))

    def frequencies(batches):
        from pyspark import TaskContext

        number, now, size = TaskContext.get().partitionId() << 32, Chunk(), 0
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                n = text.as_buffer().size if text.is_valid else 0
                if now.ids and (len(now.known) >= CHUNK_TOKENS or size + n > CHUNK_BYTES):
                    yield now.batch(number, n_buckets, b.schema.field(0).type)
                    number, now, size = number + 1, Chunk(), 0
                now.add(doc_id.as_py(), text.as_py() or "", n, path)
                size += n
            own = b.schema.field(0).type
        if now.ids:
            yield now.batch(number, n_buckets, own)

    made = cut(
        docs.select("doc_id", "text").mapInArrow(
            frequencies,
            f"chunk long, bucket int, packed binary, buckets binary, ids array<{kind}>, n_bytes array<long>, sizes array<int>, special array<int>"
        )
    )

    def pieces(batches):
        """Streams over the lists of a bucket: a pre-token is tokenised where it comes first, and looked up after that."""
        take, make, now, known = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3), None, {}
        for b in batches:
            out = []
            for bucket, packed in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                if bucket != now:
                    now, known = bucket, {}
                own = split_list(take.decompress(packed.as_buffer()))
                new = [r for r in own if r not in known]
                known.update(zip(new, count_pieces([r.decode("utf-8", "surrogateescape") for r in new], path), strict=True))
                out.append(make.compress(np.array([known[r] for r in own], "<u4").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["chunk", "bucket", "pieces"])

    lists = made.where("bucket is not null").select("chunk", "bucket", "packed")
    counted = lists.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(
        pieces, "chunk long, bucket int, pieces binary"
    )
    back = counted.groupBy("chunk").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("bucket", "pieces"))), lambda x: x["pieces"]).alias("pieces")
    )

    def sums(batches):
        make = zstandard.ZstdDecompressor()
        for b in batches:
            for ids, lengths, sizes, special, packed, buckets, got in zip(*b.columns, strict=True):
                sizes = sizes.values.to_numpy().astype(np.int64)
                places, times = unpack(make.decompress(packed.as_buffer()), sizes)
                bucket = np.frombuffer(make.decompress(buckets.as_buffer()), np.uint16)
                each = np.zeros(len(bucket), np.int64)
                if len(bucket):
                    each[np.argsort(bucket, kind="stable")] = np.frombuffer(b"".join(make.decompress(x.as_buffer()) for x in got.values), "<u4")
                total = np.concatenate([[0], np.cumsum(each[places] * times)])
                ends = np.cumsum(sizes)
                tokens = total[ends] - total[ends - sizes] + special.values.to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [ids.values, lengths.values, pa.array(tokens), pa.array(tokens > over)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
                )

    chunks = made.where("bucket is null").drop("bucket")
    whole = chunks.join(back, "chunk", "left").select("ids", "n_bytes", "sizes", "special", "packed", "buckets", "pieces")
    return whole.mapInArrow(sums, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def split_list(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def pack(places: np.ndarray, times: np.ndarray, sizes: np.ndarray) -> bytes:
    """Each document's places in ascending order as differences, then the frequencies, as little-endian uint32."""
    order = np.lexsort((places, np.repeat(np.arange(len(sizes)), sizes)))
    places = places[order]
    steps = np.diff(places, prepend=0)
    begin = (np.cumsum(sizes) - sizes)[sizes > 0]
    steps[begin] = places[begin]
    return steps.astype("<u4").tobytes() + times[order].astype("<u4").tobytes()


def unpack(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps, times = np.frombuffer(data, "<u4").astype(np.int64).reshape(2, -1)
    total = np.cumsum(steps)
    begin = np.cumsum(sizes) - sizes
    before = np.where(
        sizes > 0, total[np.minimum(begin, max(0, len(total) - 1))] - steps[np.minimum(begin, max(0, len(steps) - 1))], 0
    ) if len(total) else np.zeros(len(sizes), np.int64)
    return total - np.repeat(before, sizes), times


def op1_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))
