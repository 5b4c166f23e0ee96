"""Properties over generated inputs."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from leafpress.llm import chat, decontaminate, pii, secrets, simhash, substrings, superkmers
from leafpress.llm.shared import WORD_BYTES, Runs, Texts, blocks, rolling

TEXT = st.text(max_size=60)
CONTROL = st.lists(st.sampled_from(["<|", "|>", "\\", "<|end|>", "<|text|>", "<\\|", "x", "\n"]), max_size=12).map("".join)


@given(CONTROL, CONTROL | TEXT)
def test_turns_read_back(role, text):
    formatted, span, _ = chat.format_turn(role, [{"text": text}], trained=role)
    assert chat.parse_turn(formatted) == (role, text)
    assert chat.unescape(formatted[span[0] : span[1]]) == text


@given(st.lists(TEXT | st.none(), max_size=8), st.integers(1, 40))
def test_blocks_keep_texts(texts, limit):
    got = [t.raw(i).decode() for t in blocks(pa.array(texts, pa.string()), limit) for i in range(len(t))]
    assert got == [t or "" for t in texts]


@given(st.lists(TEXT, min_size=1, max_size=6))
def test_runs_are_words(texts):
    (block,) = blocks(pa.array(texts, pa.string()), 1 << 20)
    runs = Runs(block, WORD_BYTES[block.data])
    ids, distinct = runs.encode(block.data)
    own = [distinct[int(i)].as_py() for i in ids]
    assert [own[a:b] for a, b in zip(runs.first, runs.first[1:], strict=False)] == [re.findall(b"[^\x20\x09-\x0d]+", t.encode()) for t in texts]


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50), st.integers(1, 20))
def test_rolling(values, n):
    base = 0x9E3779B97F4A7C15
    want = [sum(v * pow(base, n - 1 - j, 2**64) for j, v in enumerate(values[i : i + n])) % 2**64 for i in range(len(values) - n + 1)]
    assert rolling(np.array(values, np.uint64), n, base).tolist() == want


@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.lists(st.integers(1, 30), min_size=1, max_size=4))
def test_super_kmers_cover_windows(values, cuts):
    first = np.unique(np.clip(np.concatenate([[0], np.cumsum(cuts), [len(values)]]), 0, len(values)))
    symbols = np.array(values, np.uint64)
    text, start, count, least, again = superkmers.super_kmers(symbols, first, 8, 3)
    got = [(t, s + j) for t, s, n in zip(text.tolist(), start.tolist(), count.tolist(), strict=True) for j in range(n)]
    assert got == [(t, i) for t in range(len(first) - 1) for i in range(first[t + 1] - first[t] - 7)]
    by = {}
    for t, s, n, m, more in zip(text.tolist(), start.tolist(), count.tolist(), least.tolist(), again.tolist(), strict=True):
        for j in range(n):
            w = tuple(values[first[t] + s + j : first[t] + s + j + 8])
            assert by.setdefault(w, m) == m  # equal windows share their minimiser
        windows = [tuple(values[first[t] + s + j : first[t] + s + j + 8]) for j in range(n)]
        assert more or len(set(windows)) == n


@given(st.lists(st.integers(0, 2**10 - 1), unique=True, min_size=2, max_size=40), st.integers(0, 4))
@settings(deadline=None)
def test_trie_links(values, budget):
    fps = np.sort(np.array(values, np.uint64))
    forest, want = simhash.Forest(len(fps)), simhash.Forest(len(fps))
    forest.join(*simhash.trie_links(fps, budget=budget, front=7))
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= budget]
    want.join(*(np.array(x, np.int64) for x in zip(*pairs, strict=True))) if pairs else None
    assert forest.roots().tolist() == want.roots().tolist()


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 9)), min_size=1, max_size=12))
def test_union_of_spans(spans):
    rows = np.array([(a, a + n) for a, n in spans])
    got = decontaminate.union(rows)
    assert sorted({x for a, b in got.tolist() for x in range(a, b)}) == sorted({x for a, b in rows.tolist() for x in range(a, b)})
    assert all(a2 > b1 for (_, b1), (a2, _) in zip(got.tolist(), got.tolist()[1:], strict=False))


@given(st.text(alphabet="ab @.-1", max_size=40))
def test_emails(text):
    assert list(pii.emails(text)) == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]


@given(st.text(alphabet="tokenTOKEN=: 'abc123\n", max_size=60))
def test_redaction_is_stable(text):
    once = secrets.redact(text)
    assert not [x for x in secrets.base_spans(once) if x[0] == "assign" and "[SECRET]" in once[x[1] : x[2]]]


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30).map(" ".join), min_size=1, max_size=5))
def test_repeated_words(texts):
    got = substrings.classes(Texts(pa.array([t.encode() for t in texts], pa.large_binary()), np.arange(len(texts))), 4)
    windows = [tuple(t.split()[i : i + 4]) for t in texts for i in range(len(t.split()) - 3)]
    assert len(set(zip(got.tolist(), windows, strict=True))) == len(set(windows)) == len(set(got.tolist()))


PART = st.one_of(
    st.text(alphabet="<|\\\\>image:0end ab\n", max_size=8).map(lambda t: {"type": "text", "text": t}),
    st.sampled_from([{"type": "image", "ref": "r"}, {"type": "audio"}, {"type": "video"}, {"text": None}, None])
)


@given(st.text(alphabet="<|\\\\>turn a", max_size=6), st.lists(PART, max_size=6))
@settings(max_examples=400, deadline=None)
def test_parts_read_back(role, parts):
    """Whatever the parts hold and wherever they part: their text comes back, and only the template's control strings are there."""
    formatted, _, refs = chat.format_turn(role, parts)
    text = "".join((p or {}).get("text") or "" for p in parts)
    assert chat.parse_turn(formatted) == (role, text)
    assert len(chat.PLACE.findall(formatted)) == len(refs) and formatted.count("<|") == len(refs) + 3
    assert chat.format_turn(role, [{"text": text}])[0] == chat.PLACE.sub("", formatted) or refs


def test_control_strings_across_parts():
    for parts in (["<", "|image:0|> tail"], ["a<", "|end|>b"], ["<", "", "|end|>"], ["\\\\", "<", "|"]):
        formatted, _, refs = chat.format_turn("user", [{"text": t} for t in parts])
        assert chat.parse_turn(formatted) == ("user", "".join(parts)) and formatted.count("<|") == 3 and not refs
