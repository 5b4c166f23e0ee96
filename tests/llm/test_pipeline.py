"""The pipeline beside its stages' operators, on the smallest tables; queries and their SQL."""

import random

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from leafpress.llm import decontaminate, mixing, quality, registry, secrets, simhash

SF = "/root/testdata/sf0.001"


def similar(texts, size=5, least=0.8):
    """The first of each component of the pairs of texts (id, text) whose sets of shingles have that Jaccard similarity."""
    sets = {}
    for i, text in texts:
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(b" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            x, y = sets[a], sets[b]
            if a < b and (x == y or min(len(x), len(y)) >= least * max(len(x), len(y)) and len(x & y) >= least * len(x | y)):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {i for i in sets if root(i) == i}


def test_stages(spark):
    docs = table = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == table.columns, name
    verdict = {r["doc_id"]: r["kept"] for r in quality.quality(table).collect()}
    kept = table.where(table.doc_id.isin([i for i, k in verdict.items() if k]))
    first = similar([(r["doc_id"], r["text"]) for r in kept.collect()])
    kept = kept.where(kept.doc_id.isin(list(first)))
    dirty = {r["doc_id"] for r in decontaminate.contamination(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
    want = {r["doc_id"]: secrets.redact(r["text"]) for r in kept.collect() if r["doc_id"] not in dirty}
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, mixing.mix(docs).collect()))


@pytest.mark.parametrize("hot", [1_000, 3])
def test_similar_texts(spark, hot):
    """Groups by similarity beside brute force: copies, near copies, chains of them, shared passages, short and empty texts."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randint(0, 4000)}"
    base = [[word() for _ in range(rng.randint(20, 150))] for _ in range(25)]
    passage, texts = [word() for _ in range(60)], [None, "", " ", "one", "one", "one two", "A b c d e", "a B c d e f"]
    for own in base:
        for _ in range(rng.randint(1, 8)):
            for _ in range(rng.randint(0, 4)):
                own = [*own]
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    texts += [" ".join([*passage, *(word() for _ in range(40))]) for _ in range(30)] + [texts[12]] * 5
    rows = [(k, t, "clash") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, code string").repartition(5)
    kept = simhash.keep_one(docs, shingle=5, similarity=0.8, budget=simhash.WIDE, hot=hot)
    got, want = {r["doc_id"] for r in kept.collect()}, similar(rows_of(rows))
    assert want <= got and len(got - want) <= (0 if hot > 3 else 2)
    assert simhash.keep_one(docs.limit(0), shingle=5, similarity=0.8).count() == 0


def rows_of(rows):
    return [r[:2] for r in rows]


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_covers_its_table(spark, name):
    table = "conversations" if name.startswith(("op7", "op12")) else "documents"
    got = registry.QUERIES[name](spark, SF).toPandas()
    source = pq.read_table(f"{SF}/{table}.parquet").to_pandas()
    if name.startswith("op12"):
        assert got.loc[got["depth"] == 0, "n_convs"].tolist() == [source["conv_id"].nunique()]
    else:
        assert len(got) == (source["conv_id"].nunique() + 1 if table == "conversations" else len(source))
    if name in registry.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "benchmark", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.execute(registry.ORACLES[name]).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        plain = lambda df: sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).map(number).values.tolist()))
        assert plain(got) == plain(want)


def number(x):
    """Whole numbers alike, as pandas has columns with nulls as floats."""
    return int(x) if isinstance(x, float) and x.is_integer() else x


def test_stages_with_clashing_names_nulls_and_no_rows(spark):
    """Null and equal ids, null texts, extra columns with the names that operators use: the columns stay, groups keep their own rows."""
    from pyspark.sql import functions as F

    good = [" ".join(f"{w}{k}x{j}" for j in range(30) for w in ("alpha", "beta", "gamma")) for k in range(4)]
    rows = [(None, good[0], "a"), (None, good[1], None), (7, good[2], "b"), (7, good[3], "b"), (8, None, "b"), (None, good[0], "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.withColumns({c: F.lit(1) for c in ("fp", "row", "size", "key", "root", "n_words", "hits", "items", "__key", "__row", "a.b")})
    for df, want in ((docs, 4), (docs.limit(0), 0)):
        out = df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, SF)
            assert out.columns == df.columns, name
        assert out.count() == want
        assert corpus_pipeline.STAGES[-1][1](spark, out, SF).count() == want


def test_run_leaves_one_table_a_stage(spark):
    from leafpress.llm import shared

    before = len(shared.MADE)
    n = corpus_pipeline.run(spark, SF).count()
    assert n and len(shared.MADE) - before < 8  # the last stage's own tables and its input


def test_pairs_in_a_hot_bucket_that_share_nothing_else(spark):
    """12 sets with one least hash in common and no other: those alike are linked, whatever the bucket's size, through shards of any number."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(6):
        own = rng.choice(2**32, 100, replace=False).astype(np.uint32)
        for twin in range(2):
            own = np.sort(np.concatenate([own[: 100 - 5 * twin], rng.choice(2**32, 5 * twin).astype(np.uint32)]))
            rows.append((bytes([2 * k + twin]), k % 2, [7, *(1000 + 10 * len(rows) + i for i in range(3))], own.tobytes()))
    nodes = spark.createDataFrame(rows, "code binary, fp long, minima array<long>, members binary")
    for hot in (100, 3, 1):  # one bucket, four shards a part, one set a shard
        buckets = simhash.cut(simhash.shared_minima(nodes.select("code", "fp", "minima"), hot))
        sets = simhash.cut(nodes.select("code", "members"))
        got = {bytes(r["node"])[0]: bytes(r["root"])[0] for r in simhash.similar_roots(buckets, sets, 0.8, simhash.WIDE, hot).collect()}
        assert got == {k: k // 2 * 2 for k in range(12)}
