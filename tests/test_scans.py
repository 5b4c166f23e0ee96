"""What is carried over pages, as scans over ranges; groups of rules as joins."""

import pickle
import random

import numpy as np
from pyspark.sql import functions as F

from leafpress.operators import geometry as G

RULES = "doc long, page int, x0 double, x1 double, y double"
UPRIGHT = "doc long, page int, x double, y0 double, y1 double"
WORDS = "doc long, page int, text string, x double, y double, size double"


def page_of(kind, rng):
    """Rules and words of a page: two tables side by side, one of as many columns, one of others, none, or two frames."""
    n, rows = {"two": 6, "same": 6, "other": rng.choice([4, 5]), "none": 0, "frames": 3}[kind], 3
    names = ["部门", "电话", "地址"] * 2 if kind == "two" else [f"w{rng.randint(0, 3)}" for _ in range(n)]
    h, v, words = [], [], []
    for left in (0.0, 500.0) if kind == "frames" else (0.0,):
        if not n:
            break
        xs = [left + 60.0 * k for k in range(n + 1)]
        h += [(12.0 * r, xs[0], xs[-1]) for r in range(rows + 1)]
        v += [(x, 0.0, 12.0 * rows) for x in xs]
        words += [(name if r == 0 else f"{r}", xs[k] + 5, 12.0 * r + 4, 10.0) for r in range(rows) for k, name in enumerate(names[:n])]
    return h, v, words


def test_pages_of_long_documents(spark):
    rng = random.Random(3)
    pages = {
        (d, p): page_of(rng.choice(["two", "same", "same", "same", "other", "none", "frames"]), rng) for d in range(3)
        for p in sorted(rng.sample(range(140), 70))
    }
    frame = lambda k, fields, kind: spark.createDataFrame(
        [(d, p, *fields(x)) for (d, p), page in pages.items() for x in page[k]], kind
    )
    h, v = frame(0, lambda x: (x[1], x[2], x[0]), RULES), frame(1, lambda x: x, UPRIGHT)
    words = frame(2, lambda x: x, WORDS)
    want = []
    for d in range(3):
        own = [(p, pages[d, p]) for dd, p in pages if dd == d and pages[d, p][0]]
        found = [G.solve_page(np.array(x[0]), np.array(x[1]), x[2]) for _, x in own]
        for (p, _), tables in zip(own, G.settle_pages(found), strict=True):
            want += [(d, p, k, c.row, c.col, c.text) for k, t in enumerate(tables, 1) for c in t.cells]
    assert {k for _, _, k, *_ in want} == {1, 2}
    for size in (1000, 5):
        got = G.tables(h, v, words, pages_per_range=size).select("doc", "page", "table", "row", "col", "text")
        assert sorted(map(tuple, got.collect())) == sorted(want)


def steps(n, rng):
    states = [None, (2, 3), (3, 2), (1, 4), (4, 1)]
    for _ in range(n):
        other = rng.choice(states) if rng.random() < 0.3 else None
        yield G.Step(other, {} if other else {s: rng.choice(states) for s in rng.sample(states[1:], rng.randint(0, 4))})


def test_composed_steps():
    for a, b, c in zip(*(steps(300, random.Random(k)) for k in range(3)), strict=True):
        assert a.then(b).then(c)((2, 3)) == a.then(b.then(c))((2, 3)) == c(b(a((2, 3))))
        assert a.then(b)(None) == b(a(None))


def test_states_of_one_document_in_several_tasks(spark):
    n, size = 100_000, 1000
    made = list(steps(n, random.Random(9)))
    df = spark.createDataFrame([(7, p, p // size, pickle.dumps(s)) for p, s in enumerate(made)], "doc long, page long, part long, step binary")
    got = {r["part"]: r["state"] and pickle.loads(r["state"]) for r in G.states(df, "bigint").collect()}
    state, want = None, {}
    for p, s in enumerate(made):
        if p % size == 0:
            want[p // size] = state
        state = s(state)
    assert got == want and len({str(x) for x in want.values()}) > 2
    dealt = df.repartition(4, "doc", "part").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == 4 and max(r["count"] for r in dealt) < n / 2


def test_chains_of_one_long_document(spark):
    """100,000 pages of two tables each, ids over ranges of pages as over all of them."""
    df = spark.range(200_000).select(
        F.lit("d").alias("doc"), (F.floor(F.col("id") / 2) + F.when(F.col("id") > 90_000, 3).otherwise(0)).cast("int").alias("page"),
        (F.col("id") % 2 + 1).cast("int").alias("table"), (F.pmod(F.xxhash64(F.floor(F.col("id") / 9)), F.lit(2)) + 2).cast("int").alias("columns"),
        F.array(F.lit("x")).alias("signature"), F.array().cast("array<double>").alias("profile")
    )
    got = G.chains(df, pages_per_range=500).select("page", "table", "columns", "continues_from_previous", "continued_on_next", "continuation_id").toPandas()
    got = got.sort_values(["page", "table"]).reset_index(drop=True)
    names, count, last = [], 0, {}
    for page, table, columns in got[["page", "table", "columns"]].itertuples(index=False):
        before = last.get(table)
        same = before is not None and before[0] == page - 1 and before[1] == columns
        count += not same
        last[table] = (page, columns, before[2] if same else f"table-chain-{count}")
        names.append((same, last[table][2]))
    assert got["continues_from_previous"].tolist() == [x for x, _ in names] and got["continuation_id"].tolist() == [x for _, x in names]
    following = {(p - 1, t) for p, t, c in got[["page", "table", "continues_from_previous"]].itertuples(index=False) if c}
    assert got["continued_on_next"].tolist() == [(p, t) in following for p, t in got[["page", "table"]].itertuples(index=False)]


def test_components_beside_groups(spark):
    rng = np.random.default_rng(4)
    pages = []
    for p in range(12):
        h = np.column_stack([rng.uniform(0, 300, 25), x := rng.uniform(0, 250, 25), x + rng.uniform(10, 90, 25)])
        v = np.column_stack([rng.uniform(0, 300, 25), y := rng.uniform(0, 250, 25), y + rng.uniform(10, 90, 25)])
        pages.append((p, h[np.lexsort((h[:, 2], h[:, 1], h[:, 0]))], v))
    # a staircase: a chain as long as the page
    k = np.arange(60.0)
    pages.append((99, np.column_stack([k * 10, k * 10, k * 10 + 10]), np.column_stack([k * 10 + 10, k * 10, k * 10 + 10])))
    h, v = G.crossing_ids(
        spark.createDataFrame([(1, p, float(a), float(b), float(y)) for p, hs, _ in pages for y, a, b in hs], RULES),
        spark.createDataFrame([(1, p, *map(float, x)) for p, _, vs in pages for x in vs], UPRIGHT)
    )
    for least in (1, 3):
        got = {}
        for r in G.components(h, v, least).where("id > 0").collect():
            got.setdefault((r["page"], r["component"]), set()).add(r["id"])
        want = []
        for p, hs, vs in pages:
            for own, _ in G.grouped(hs, vs, least):
                want.append((p, frozenset(int(np.flatnonzero((hs == x).all(axis=1))[0]) + 1 for x in own)))
        assert sorted((p, sorted(x)) for (p, _), x in got.items()) == sorted((p, sorted(x)) for p, x in want)
        assert all(c == min(x) for (_, c), x in got.items())


def test_components_send_nothing_to_the_driver(spark, monkeypatch):
    """However small the labels' files are, no round broadcasts them."""
    cut, plans = G.scratch.cut, []

    def seen(df):
        plans.append(df)
        return cut(df)

    monkeypatch.setattr(G.scratch, "cut", seen)
    h, v = spark.createDataFrame([(1, 1, 0.0, 90.0, float(k)) for k in range(5)], RULES), spark.createDataFrame([(1, 1, float(k), 0.0, 9.0) for k in range(5)], UPRIGHT)
    plans.append(G.components(*G.crossing_ids(h, v)))
    assert plans[-1].count() == 10 and len(plans) > 2
    assert not any("Broadcast" in p._jdf.queryExecution().executedPlan().toString() for p in plans)
