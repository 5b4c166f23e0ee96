"""Conversation tries beside brute force, and the cases of the docstring."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from leafpress.llm import prefixes

RNG = random.Random(12)
WORD = "[^\x20\x09-\x0d]+"


def brute(convs):
    """``convs``: id -> list of (role, text)."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    below = {k: [x for x in members if x[: len(k)] == k] for k in members}
    words = lambda k: len(re.findall(WORD, k[-1][1])) if k else 0
    out = []
    for k, own in members.items():
        children = [x for x in below[k] if len(x) == len(k) + 1]
        leaves = sum(not any(len(y) > len(x) for y in below[x]) for x in below[k])
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(k))
        out.append(
            (
                min(own), len(k), min(members[k[:-1]]) if k else None, len(own), len(children), leaves,
                sum((len(members[x]) - 1) * words(x) for x in below[k]), hashlib.sha256(ends.encode()).hexdigest()
            )
        )
    return sorted(map(repr, out))


def nodes(df):
    return sorted(repr(tuple(r)[:8]) for r in df.collect())


def made(n, odd=True):
    rows = []
    for c in range(-n // 3, n):
        for t in range(RNG.randint(0, 6)):
            text = RNG.choice(["", "a", "a b", "é 日本 x", None]) if odd else RNG.choice(["a", "b c"])
            rows.append((c * 7 if c % 2 else c, None if t == 3 and odd else t, RNG.choice(["user", "assistant", None]), text))
    return rows


def read(rows):
    """Conversations of rows, in the operator's order."""
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.sha256(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).digest())
    out = {}
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("depth", "digest", "at", "own", "words")}).repartition(3)


def test_trie(spark):
    rows = made(60)
    rows += [rows[3], rows[3], (None, 1, "user", "lost"), *((900 + k, t, "user", f"t {t}") for k in range(40) for t in range(3))]
    got = prefixes.prefix_trie(frame(spark, rows))
    assert nodes(got) == brute(read(rows))


def test_rebuilt(spark):
    """The query's conversations: the first turns of the first of each twenty, then the own ones; turnless ones are members of the root."""
    rows = made(50)
    before = read(rows)
    want = {}
    for c in before:
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        want[c] = before.get(first, [])[:h] + before[c][h:]
    assert any(not v for v in want.values())
    placed = prefixes.numbered(prefixes.known(frame(spark, rows)))
    assert nodes(prefixes.trie(prefixes.chained(*prefixes.rebuilt(placed)).cache())) == brute(want)


def test_no_turns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefixes.prefix_trie(empty).count() == 0
    ids = spark.createDataFrame([(4,), (4,), (None,), (2,)], "conv_id long")
    assert nodes(prefixes.prefix_trie(empty, ids)) == brute({4: [], 2: []})


def test_long_conversation_and_hot_node(spark):
    """A chain of thousands of turns sends as many rows up; thousands of members of one node."""
    deep = [(1, t, "user", "w " * (t % 3)) for t in range(4000)]
    hot = [(10 + k, 0, "user", "hello there") for k in range(5000)]
    got = {(r["depth"], r["conv_id"]): r for r in prefixes.prefix_trie(spark.createDataFrame(deep + hot, SCHEMA)).collect()}
    assert len(got) == 4002
    root, node = got[0, 1], got[1, 10]
    assert root["n_convs"] == 5001 and root["n_children"] == 2 and root["n_leaves"] == 2 and root["saved_tokens"] == 4999 * 2
    assert node["ends_sha256"] == hashlib.sha256(",".join(map(str, range(10, 5010))).encode()).hexdigest()
    assert got[4000, 1]["n_children"] == 0 and got[3999, 1]["n_children"] == 1
