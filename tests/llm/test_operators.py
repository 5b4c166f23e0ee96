"""Each operator beside brute force on a small fixture, and the cases that its docstring defines."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leafpress.llm import chat, decontaminate, mixing, pii, quality, secrets, simhash, substrings, suffixes, superkmers, tokens

RNG = random.Random(17)
WORDS = [f"w{k}" for k in range(150)] + ["the", "of", "é", "日本", "AbC", "x|y", "#tag"]
SPACE = "[^\x20\x09-\x0d]+"


def prose(n):
    return "".join(RNG.choice(WORDS) + RNG.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(n))


PASSAGE = prose(90)
NEAR = [RNG.choice(WORDS) for _ in range(120)]


def corpus():
    texts = [None, "", " \n ", "one", "a" * 450, "a" * 450, "ab" * 300, "word " * 200, "x " * 49]
    texts += [prose(RNG.randint(0, 160)) for _ in range(40)]
    texts += [prose(RNG.randint(0, 40)) + PASSAGE + prose(RNG.randint(0, 40)) for _ in range(25)]
    for _ in range(30):
        near = list(NEAR)
        near[RNG.randrange(len(near))] = RNG.choice(WORDS)
        texts.append(" ".join(near))
    texts += [texts[12]] * 4 + ["A line that repeats itself here\n" * 9 + prose(90)]
    return list(enumerate(texts)) + [(10, texts[10])]  # a repeated row


DOCS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    """Columns with the names that operators use inside are there to clash."""
    rows = [(i, t, None if i % 7 == 3 else f"src{i % 4}", 1, "z") for i, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, uid int, hits string").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def rows(df):
    return collections.Counter(map(tuple, df.collect()))


def words(text):
    return re.findall(SPACE, text or "")


# 1


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.default_path())
    want = collections.Counter((i, len((t or "").encode()), n := len(own.encode(t or "", add_special_tokens=False).ids), n > 100) for i, t in DOCS)
    for buckets in (None, 3):
        assert rows(tokens.token_counts(docs, over=100, buckets=buckets)) == want
    assert tokens.token_counts(empty).count() == 0


@pytest.mark.parametrize(
    "text",
    [
        "a<|endoftext|> b<|endoftext|>", "日本語テキスト😀 x՘y", "   lead  \n\n trail   ", "it's we'll\xa0　 z", "\U0003fc36 a₏1", "<|endoftext",
        "٣٤ ½ ǅ"
    ]
)
def test_pre_tokens(text):
    from tokenizers import Tokenizer

    path = tokens.default_path()
    pre, special = tokens.pre_tokens(text, path)
    assert sum(tokens.count_pieces(pre, path)) + special == len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)


def test_agreed_code_points():
    """Over all of Unicode that counts as agreed, the two splitters give the same pre-tokens."""
    own, split, _ = tokens.tokenizer(tokens.default_path())
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000 or not tokens.AGREED.fullmatch(chr(c)):
            continue
        s = f"a{chr(c)}1{chr(c)}!{chr(c)}"
        assert [b - a for _, (a, b) in own.pre_tokenizer.pre_tokenize_str(s)] == [len(x) for x in split.findall(s)], hex(c)


def test_packing():
    sizes = np.array([0, 3, 0, 2, 1, 0])
    places, times = np.array([5, 1, 9, 0, 7, 2]), np.arange(1, 7)
    got = tokens.unpack(tokens.pack(places, times, sizes), sizes)
    assert got[0].tolist() == [1, 5, 9, 0, 7, 2] and got[1].tolist() == [2, 1, 3, 4, 5, 6]


# 2

BASE_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"
}


def plain_luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(text):
    keep = {
        "email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 16 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and plain_luhn(d),
        "phone": lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15
    }
    return sorted((k, m.start(), m.end()) for k, p in BASE_PII.items() for m in re.finditer(p, text) if keep[k](m.group()))


def test_base_pii():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("aZ9.@+- ()1234567890..@@-4\n") for _ in range(rng.randint(0, 70)))
        assert sorted(pii.base_spans(text)) == brute_pii(text), text
    assert pii.base_spans("1" * 200_000 + "." * 10 + "a" * 200_000) == []


def test_semi_crf():
    weights, rng, hit, extra, missed = pii.train(), random.Random(99), 0, 0, 0
    assert weights == pii.train.__wrapped__()
    for _ in range(300):
        text, gold = pii.sentence(rng)
        got = set(pii.viterbi(text, weights))
        hit, extra, missed = hit + len(got & set(gold)), extra + len(got - set(gold)), missed + len(set(gold) - got)
    assert hit / (hit + extra) > 0.97 and hit / (hit + missed) > 0.97
    text = "write to jo at example dot com or call (499) 555-6503, section 4.0 of 2024-05-17, number 12345678"
    found = pii.added_spans(text, pii.base_spans(text), weights)
    assert [(k, text[s:e]) for k, s, e in found] == [("email", "jo at example dot com"), ("phone", "(499) 555-6503")]


@pytest.mark.parametrize(
    "text",
    [
        "JO AT EXAMPLE DOT COM", "jo (at ) example.com", "jo at example.com", "jo at example (dot) com",
        "write to jo at mail.example [dot]com"
    ]
)
def test_added_without_digits(spark, text):
    """A span that the field finds in the whole text is found in rows, whether or not a digit stands far away."""
    kept = [x for x in pii.viterbi(text, pii.train()) if x[0] == "email"]
    assert kept and pii.added_spans(text, [], pii.train()) == kept
    rows = [(1, text), (2, text + " word" * 40 + " 7")]
    got = pii.find_personal_data(spark.createDataFrame(rows, "doc_id int, text string")).orderBy("doc_id").collect()
    assert [r["spans"] for r in got] == [pii.digest(kept)] * 2


def test_pii_rows(docs, empty, spark):
    assert pii.find_personal_data(docs).count() == len(DOCS) and pii.find_personal_data(empty).count() == 0
    text = "m a.b@c.de, +1 (499) 555-6503 and 4111 1111 1111 1111"
    r = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 0, 1, 1)
    listed = ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(brute_pii(text), key=lambda x: (list(BASE_PII).index(x[0]), x[1])))
    assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest() and r["spans"] == listed


# 3


def brute_quality(text):
    w = words(text)
    grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    repeat = {k + j for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(SPACE, line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeat), len(w) < 50 or 100 * len(repeat) > 50 * len(w)


def brute_over(text, limits):
    w = words(text)
    total = max(sum(map(len, w)), 1)
    worst = 0.0
    for n in (*limits.top, *limits.duplicated):
        grams = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
        count = collections.Counter(grams)
        if n in limits.duplicated:
            inside = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(n)}
            worst = max(worst, sum(len(w[k]) for k in inside) / total / limits.duplicated[n])
        else:
            worst = max([worst, *(c * sum(map(len, g)) / total / limits.top[n] for g, c in count.items() if c > 1)])
    lines = [x for x in (text or "").split("\n") if re.search(SPACE, x)]
    dup = [x for k, x in enumerate(lines) if x in lines[:k]]
    return worst > 1 or (
        len(lines) > 1 and len(dup) > limits.lines * len(lines)
    ) or sum(map(len, dup)) > limits.line_chars * max(1, sum(map(len, lines)))


def test_quality(docs, empty):
    limits = quality.Limits(top={2: 0.03, 3: 0.03}, duplicated={5: 0.1, 7: 0.1}, lines=0.3, line_chars=0.3)
    got = collections.Counter(tuple(r)[:-1] for r in quality.quality(docs, limits).collect())
    want = collections.Counter((i, *(b := brute_quality(t)), not b[-1] and not brute_over(t, limits)) for i, t in DOCS)
    assert got == want and any(not k[-1] and not k[-2] for k in got)
    assert rows(quality.filter_quality(docs, limits).select("doc_id")) == collections.Counter((k[0],) for k in want.elements() if k[-1])
    assert quality.quality(empty).count() == 0


# 4, 5


def brute_repeats(units, length):
    key = lambda u, i: bytes(u[i : i + length]) if isinstance(u, bytes) else tuple(u[i : i + length])
    count = collections.Counter(key(u, i) for u in units for i in range(len(u) - length + 1))
    for u in units:
        gone = np.zeros(len(u) + 1, bool)
        for i in range(len(u) - length + 1):
            if count[key(u, i)] > 1:
                gone[i : i + length] = True
        kept = bytes(
            x for x, g in zip(u, gone, strict=False) if not g
        ) if isinstance(u, bytes) else b" ".join(x for x, g in zip(u, gone, strict=False) if not g)
        yield len(u), int(gone.sum()), int(
            (gone[:-1] & ~np.concatenate([[False], gone[:-2]]))[: len(u)].sum()
        ) if len(u) else 0, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("hot,bits", [(4000, 64), (5, 64), (60, 8)])
@pytest.mark.parametrize("operator,length", [(suffixes.remove_repeated_bytes, 200), (substrings.remove_repeated_words, 35)])
def test_repeats(docs, operator, length, hot, bits):
    units = [(t or "").encode() for _, t in DOCS]
    units = units if length == 200 else [u.split() for u in units]
    want = collections.Counter((i, *b) for (i, _), b in zip(DOCS, brute_repeats(units, length), strict=True))
    assert rows(operator(docs, hot=hot, bits=bits).drop("removed")) == want


@pytest.mark.parametrize("unit", [superkmers.Bytes(), superkmers.Words()])
def test_hot_strings_become_few_pieces(unit):
    """A string around a hot k-mer, with all windows that hold it, is cut into a few pieces by the next k, not one a window."""
    import pyarrow as pa

    rng, n = random.Random(3), 40
    for deal in range(1, len(unit.ks)):
        size = 2 * unit.length - unit.ks[deal - 1]
        strings = [rng.randbytes(size) if unit.name == "bytes" else b" ".join(b"%d" % rng.randrange(10**6) for _ in range(size)) for _ in range(n)]
        batch = pa.RecordBatch.from_arrays(
            [pa.array(range(n), pa.int64()), pa.array([0] * n, pa.int32()), pa.array([True] * n), pa.array(strings, pa.binary())], ["uid", "start", "once", "s"]
        )
        if deal > 1:  # the first cuts whole super-k-mers
            assert sum(b.num_rows for b in superkmers.cutter(unit, deal)([batch])) <= 8 * n
    assert unit.ks[-1] == unit.length


def test_repeats_of_nothing(empty):
    assert suffixes.remove_repeated_bytes(empty).count() == 0 and substrings.remove_repeated_words(empty).count() == 0


def test_merged_transforms():
    """The interleave of two shards' transforms is the order of all suffixes, and its common prefixes are right."""
    import pyarrow as pa

    from leafpress.llm.shared import Texts

    rng = random.Random(8)
    for _ in range(150):
        strings = ["".join(rng.choice("ab") for _ in range(rng.randint(8, 30))).encode() for _ in range(rng.randint(1, 6))]
        windows = [s[i : i + 8] for s in strings for i in range(len(s) - 7)]
        for shard in (1 << 18, 20):  # two shards, or many in rounds
            got = suffixes.classes(Texts(pa.array(strings, pa.large_binary()), np.arange(len(strings))), 8, 2, shard)
            assert len(set(zip(got.tolist(), windows, strict=True))) == len(set(windows)) == len(set(got.tolist()))


# 6


def low(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


@pytest.mark.parametrize("bits", [20, 3])
def test_contamination(spark, docs, empty, bits, monkeypatch):
    """Also where the filter lets everything through."""
    monkeypatch.setattr(decontaminate, "LEAST_BITS", bits)
    monkeypatch.setattr(decontaminate, "MOST_BITS", max(bits, 4))
    items = [
        (1, PASSAGE[:150]), (2, "W3 the"), (3, None), (4, "..."), (None, "日本"), (6, "one"), (6, "of the of the of the w1 w2 w3 w4 w5 w6"),
        (7, " ".join(NEAR[5:40]))
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = low(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add("" if i is None else str(i))
    want = collections.Counter()
    for i, t in DOCS:
        w, hit, found = low(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= got
        want[i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    assert rows(decontaminate.contamination(docs, bench).drop("hits", "items")) == want
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and rows(kept.select("doc_id")) == collections.Counter((k[0],) for k in want.elements() if not k[-1])
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0


# 7


def test_chat(spark):
    rng = random.Random(5)
    bits = ["<|", "|>", "\\", "<|end|>", "<|image:0|>", "\n", "é", "<\\|", "ok", "<|turn|>"]
    data = [
        (
            c, t, rng.choice(["user", "assistant", "system", None, "a|<|b"]),
            rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))])
        )
        for c in (1, 2, None) for t in (0, 1, 1, None, 3)
    ]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("parts", F.lit(3))
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(df)).collect()}
    groups = collections.defaultdict(list)
    for c, t, r, x in data:
        groups[c].append((-1 if t is None else t, chat.format_turn(r or "", [{"text": x}])[0], r or "", x or ""))
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == (
            len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(f) for _, f, *_ in turns)
        )
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_typed_parts(spark):
    parts = [
        ("text", "see <|", None, None, None, None, None), ("image", None, "s3://i", 56, 57, None, None),
        ("audio", None, "a", None, None, 2.0, None), ("document", None, "d", None, None, None, 3),
        ("text", "end", None, None, None, None, None)
    ]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None)], f"conv_id long, turn int, role string, body array<{chat.PART}>")
    a, b = chat.format_conversations(df, parts="body").orderBy("turn").collect()
    assert a["formatted"] == "<|turn|>assistant<|text|>see <\\|<|image:0|><|audio:1|><|document:2|>end<|end|>"
    assert [tuple(x) for x in a["attachments"]] == [(0, "image", "s3://i", 6), (1, "audio", "a", 50), (2, "document", "d", 1536)]
    assert chat.parse_turn(a["formatted"]) == ("assistant", "see <|end") and b["loss_start"] is None and b["formatted"] == "<|turn|>user<|text|><|end|>"
    other = chat.format_turn("user", [{"type": "video", "ref": "v"}, {"type": "attach"}, {"type": "text", "text": "<|other:0|>"}])
    assert other == ("<|turn|>user<|text|><|other:0|><|other:1|><\\|other:0|><|end|>", None, [(0, "video", "v", 0), (1, "attach", None, 0)])
    assert chat.parse_turn(other[0]) == ("user", "<|other:0|>")


def test_very_long_turn(spark):
    text = "a<|\\" * 200_000
    df = spark.createDataFrame([(None, 0, "assistant", text), (None, 1, None, None)], "conv_id string, turn int, role string, text string")
    r = chat.digests(chat.format_conversations(df)).first()
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())


# 8

BASE_SECRETS = {
    "assign": r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
}


def brute_secrets(text):
    keep = {"assign": lambda m: len(m.group(2)) >= 8, "access": lambda m: len(m.group()) >= 16, "hex": lambda m: len(m.group()) >= 32}
    return sorted((k, m.start(), m.end()) for k, p in BASE_SECRETS.items() for m in re.finditer(p, text) if keep[k](m))


def test_base_secrets():
    rng = random.Random(4)
    bits = [
        "token", "=", " ", "AKIA", "ABCDEF12", "abcdef0123456789", "password", ":", '"', "ſecret", "Token", "api_key", "apikey", "x",
        "AKIAAKIAAKIAAKIA", "0" * 40, "\n"
    ]
    for _ in range(10_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert sorted(x[:3] for x in secrets.base_spans(text)) == brute_secrets(text), text


def test_linked_secrets(spark, docs, empty):
    weak = "A7f9Qx2LmP0vTz8KwR4bYn6D"
    text = f"cfg\nclient_id=app-prod-7731\nkey {weak}\nhost: db.example.com\n\nnothing {weak} here"
    r = secrets.find_secrets(
        spark.createDataFrame([(1, text), (2, f"only {weak}"), (3, None)], "doc_id int, text string")
    ).orderBy("doc_id").collect()
    assert r[0]["spans"] == "identifier:4:27,secret:32:56,endpoint:57:77" and r[0]["n_linked"] == 3
    assert r[1]["spans"] == r[2]["spans"] == "" and r[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert secrets.redact(text).count("[SECRET]") == 2 and secrets.redact(text).endswith(f"{weak} here")
    assert secrets.redact("token = abcdefgh1") == "token = [SECRET]"
    assert secrets.find_secrets(empty).count() == 0
    out = secrets.redact_secrets(docs.withColumn("n_chars", F.length("text")))
    assert out.count() == len(DOCS) and out.where("n_chars <> length(text)").count() == 0


def test_linked_secrets_at_any_line():
    """Whether a pair is linked depends on its distance, not on where it stands."""
    weak = "A7f9Qx2LmP0vTz8KwR4bYn6D"
    for before in range(30):
        for apart in range(1, 16):
            text = "plain\n" * before + "client_id=app-prod-7731\n" + "plain\n" * (apart - 1) + f"key {weak}\nend"
            got = [x[0] for x in secrets.linked_spans(text, secrets.base_spans(text))]
            assert got == (["identifier", "secret"] if apart < secrets.SCOPE_LINES else []), (before, apart)
            assert secrets.redact(text).count("[SECRET]") == len(got)
    blank = f"client_id=app-prod-7731\n \t\nkey {weak}\nhost: db.example.com"
    assert secrets.linked_spans(blank, []) == []
    # the endpoint needs one scope with both
    spread = lambda n: "client_id=app-prod-7731\n" + "plain\n" * 5 + f"key {weak}\n" + "plain\n" * n + "host: db.example.com"
    assert [[x[0] for x in secrets.linked_spans(spread(n), [])][2:] for n in (4, 5)] == [["endpoint"], []]


def test_long_identifier_is_redacted_whole():
    text = "client_id={}\nkey A7f9Qx2LmP0vTz8KwR4bYn6D"
    assert [secrets.redact(text.format(x * n)) for x, n in (("x", 128), ("x", 129), ("a.b-", 1000))] == ["client_id=[SECRET]\nkey [SECRET]"] * 3


# 9


def brute_fingerprint(text, n=3):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + n]), 42) for k in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, fps, budget):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if (fps[a] ^ fps[b]).bit_count() <= budget:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("bucket", [50_000, 2])
@pytest.mark.parametrize("budget", [3, 6])
def test_simhash(docs, empty, bucket, budget):
    fps = {i: brute_fingerprint(t) for i, t in DOCS}
    want = collections.Counter((i, f"{fps[i]:016x}", c) for c in [None] for i, _ in DOCS)
    of = classes(sorted(fps), fps, budget)
    want = collections.Counter((i, f"{fps[i]:016x}", of[i]) for i, _ in DOCS)
    assert rows(simhash.near_duplicates(docs, budget=budget, bucket=bucket)) == want
    kept = simhash.keep_one(docs, budget=budget, bucket=bucket)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(of.values()))
    assert simhash.near_duplicates(empty).count() == 0


def test_keep_one_of_each_group(spark):
    """Rows with null or equal ids that lie in different groups all stay."""
    rng = random.Random(3)
    far = [" ".join(rng.choice(WORDS[:150]) for _ in range(80)) for _ in range(6)]
    assert len(set(classes(range(6), [brute_fingerprint(t) for t in far], 3).values())) == 6
    rows = [
        (None, far[0]), (None, far[1]), (None, far[1]), (None, far[2]), (5, far[2]), (6, far[3]), (6, far[4]), (6, far[4]), (7, far[4]),
        (7, far[5]), (7, far[5].upper())
    ]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(None, far[0]), (None, far[1]), (5, far[2]), (6, far[3]), (6, far[4]), (7, min(far[5], far[5].upper()))]
    assert collections.Counter(map(tuple, kept)) == collections.Counter(want)


def test_trie_spans_chains():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 2**63, 40, dtype=np.uint64)
    for _ in range(3):  # chains of near ones
        fps = np.concatenate(
            [
                fps,
                fps ^ (
                    np.uint64(1) << rng.integers(0, 64, len(fps)).astype(np.uint64)
                ) ^ (np.uint64(1) << rng.integers(0, 64, len(fps)).astype(np.uint64))
            ]
        )
    fps = np.unique(fps)
    forest = simhash.Forest(len(fps))
    a, b = simhash.trie_links(fps, front=50)
    assert len(a) < len(fps) and len(forest.join(a, b)) == len(a)
    of = classes(range(len(fps)), {k: int(x) for k, x in enumerate(fps)}, 3)
    assert forest.roots().tolist() == [of[k] for k in range(len(fps))]


# 10


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    left, total, target = {s: weights[k % 3] for k, s in enumerate(order)}, sum(sizes.values()), dict.fromkeys(order, 0.0)
    while left and total > 1e-9:
        share = {s: total * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in left if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return target | share
        for s in over:
            target[s] = float(most * sizes[s])
            total -= target[s]
            del left[s]
    return target


@pytest.mark.parametrize("shard_rows", [5000, 3])
def test_mix(docs, empty, shard_rows):
    got = mixing.mix(docs, shard_rows=shard_rows).collect()
    source = {i: None if i % 7 == 3 else f"src{i % 4}" for i, _ in DOCS}
    sizes = collections.Counter()
    for i, t in DOCS:
        sizes[source[i]] += len(words(t))
    want = brute_targets(sizes)
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((i, len(words(t))) for i, t in DOCS)
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, n in taken.items():
        assert n == pytest.approx(want[s], rel=0.02, abs=20)
    assert rows(mixing.mix(docs, shard_rows=shard_rows)) == collections.Counter(map(tuple, got))
    assert mixing.mix(empty).count() == 0


def test_mix_of_small_sources(spark):
    """Each source comes near its target also where it is small beside the others."""
    count = {"a": [300_000] * 40, "b": [110] * 10, "c": [10] * 10, "d": [300_000] * 40}
    docs = [(k, s, n) for s, sizes in count.items() for k, n in enumerate(sizes)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n int").select("doc_id", "source", F.repeat(F.lit("w "), F.col("n")).alias("text"))
    got = mixing.mix(df).groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect()
    assert {r["source"]: r["target"] for r in got if r["source"] in "bc"} == {"b": 3300, "c": 300}
    for r in got:
        assert r["taken"] == pytest.approx(r["target"], rel=0.005), r


def test_apportionment(spark):
    rng = random.Random(6)
    for seats in (0, 3, 7, 100, 1001):
        shares = [(k, float(rng.choice([0, 1, 5, 17, 400, 1000.5]))) for k in range(12)]
        got = {
            r["k"]: r["quota"]
            for r in mixing.apportion(
                spark.createDataFrame(shares, "k int, s double").withColumn("seats", F.lit(seats)), "s", ["k"], "seats"
            ).collect()
        }
        quotients = sorted(((s / (2 * j - 1), -k) for k, s in shares for j in range(1, seats + 1) if s > 0), reverse=True)[:seats]
        assert got == {k: sum(-q[1] == k for q in quotients) for k, _ in shares}


@pytest.mark.parametrize("text", ["x" * 300_000, " ".join(["long"] * 60_000), "é" * 100_000])
def test_very_long_text(spark, text):
    df = spark.createDataFrame([(1, text, "s"), (2, None, None)], "doc_id long, text string, source string")
    for f in (
        tokens.token_counts, pii.find_personal_data, quality.quality, suffixes.remove_repeated_bytes, substrings.remove_repeated_words,
        secrets.find_secrets, simhash.near_duplicates, mixing.mix
    ):
        assert f(df).count() == 2


def test_scratch_is_shared_and_released(spark, docs):
    import os

    from leafpress.llm import shared

    assert shared.scratch_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    kept = shared.cut(docs.select("doc_id"))
    folder = f"{shared.scratch_dir(spark)}/{spark.sparkContext.applicationId}"
    assert kept.count() == len(DOCS) and os.listdir(folder)
    shared.release(spark)
    assert not os.path.exists(folder)
