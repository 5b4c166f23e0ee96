"""License scans beside brute force, and the cases of the docstring."""

import random

import pytest

from leafpress.llm import licenses

RNG = random.Random(5)
NOTICES = [text for _, text in licenses.TEMPLATES]


def noise(n):
    return " ".join(RNG.choice(["the", "of", "license", "licensed", "under", "4", "0", "Wort", "é", "日本", "you"]) for _ in range(n))


def changed(text):
    """A notice with words put in, left out and replaced."""
    own = text.split()
    for _ in range(RNG.randint(0, 4)):
        at = RNG.randrange(len(own))
        own[at : at + RNG.randint(0, 1)] = [RNG.choice(["indeed", "LICENSE,", "so"])] * RNG.randint(0, 2)
    return " ".join(own)


def brute(text, roll=licenses.ROLL, drift=licenses.DRIFT, least=licenses.LEAST):
    own = licenses.words(text or "")
    places = {label: [i for i in range(len(own)) if own[i : i + len(p.split())] == p.split()] for p, label in licenses.PHRASES}
    every = sorted(x for v in places.values() for x in v)
    base, more, score = {k for k, v in places.items() if v}, set(), 0.0
    for label, notice in licenses.TEMPLATES:
        want = licenses.words(notice)
        diagonals = sorted(
            {p - t for t in range(len(want) - roll + 1) for p in range(len(own) - roll + 1) if own[p : p + roll] == want[t : t + roll]}
        )
        groups = []
        for d in diagonals:
            if groups and d - groups[-1][-1] <= drift:
                groups[-1].append(d)
            else:
                groups.append([d])
        for g in groups:
            share = sum(any(0 <= d + t < len(own) and own[d + t] == want[t] for d in g) for t in range(len(want))) / len(want)
            if share >= least:
                more.add(label)
                score = max(score, share)
    ends = (every[0], every[-1]) if every else (None, None)
    return len(own), len(every), *ends, ",".join(sorted(base)), ",".join(sorted(base | more)), score


TEXTS = [
    None, "", " \n", "mit", "MIT LICENSE", "the mit License mit license apache license", "general public", "general public license",
    *NOTICES, *[noise(RNG.randint(0, 30)) + "\n" + changed(RNG.choice(NOTICES)) + " " + noise(RNG.randint(0, 30)) for _ in range(60)],
    *[noise(80) for _ in range(10)], " ".join([NOTICES[0]] * 40), NOTICES[4] + " x " + NOTICES[4],
]


def test_scan(spark):
    rows = [(k if k % 5 else None, t, "clash", "own") for k, t in enumerate(TEXTS)] + [(1, TEXTS[9], "a", "b")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, spans string").repartition(3)
    got = [tuple(r)[:8] for r in licenses.scan_licenses(docs).collect()]
    assert sorted(map(repr, got)) == sorted(repr((r[0], *brute(r[1]))) for r in rows)


def test_spans_of_changed_notices(spark):
    """Where a third of a notice's words are other ones it is still found, at its place; a text of the same words in another order is not."""
    notice = licenses.words(NOTICES[2])
    near = [w if k % 9 else "other" for k, w in enumerate(notice)]
    rows = [(1, "a b c " + " ".join(near) + " d"), (2, " ".join(sorted(notice)))]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["labels"] == "bsd" and not got[2]["labels"]
    (span,) = got[1]["spans"]
    assert 3 <= span["first"] < span["last"] <= 2 + len(notice) and span["share"] == pytest.approx(sum(w != "other" for w in near) / len(near))


def test_no_rows_no_templates(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan_licenses(empty).count() == 0
    some = spark.createDataFrame([(1, "mit license")], "doc_id long, text string")
    (row,) = licenses.scan_licenses(some, templates=(), phrases=()).collect()
    assert row["n_words"] == 2 and not row["labels"] and row["n_base"] == 0
    with pytest.raises(ValueError, match="fewer"):
        licenses.scan_licenses(some, templates=(("x", "one two"),))


def test_hot_text_and_long_text(spark):
    """Many copies of a text are voted for once; a long text with many notices keeps its places."""
    long = ("word " * 50 + NOTICES[0] + " ") * 3000
    rows = [(k, TEXTS[12]) for k in range(3000)] + [(-1, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    assert len(got) == 3001 and got[5]["labels"] == brute(TEXTS[12])[5] and got[5]["score"] == brute(TEXTS[12])[6]
    assert got[-1]["n_base"] == 3000 and len(got[-1]["spans"]) >= 3000 and got[-1]["n_words"] == 58 * 3000


def test_native(spark):
    docs = spark.createDataFrame([(1, NOTICES[0])], "doc_id long, text string")
    plan = licenses.scan_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
