"""Search over trigrams, and encodings told in the JVM."""

import random

import pytest
from pyspark.sql import functions as F

from leafpress.functions import encodings as E
from leafpress.operators import trigrams as G
from leafpress.sources import readers as R


def test_find(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK_BITS", 4)
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice("abcABC%_ é") for _ in range(rng.randint(0, 30))), None if k % 7 == 0 else rng.choice(["Report", "reporter", "x"])) for k in range(300)]
    df = spark.createDataFrame(rows, "id int, name string, kind string").repartition(3)
    own = G.index(df, "name", "kind")
    for n in (0, 1, 2, 3, 4, 7, 12, 30):
        q = (rows[n * 7 + 5][1][:n] if n else "") or "rep"[:n]
        want = {r[0] for r in rows if q.strip() and any(q.strip().lower() in (f or "").lower() for f in r[1:])}
        assert {r["id"] for r in G.find(own, q).collect()} == want, q
    assert {r["id"] for r in G.find(own, "REPORTER").collect()} == {r[0] for r in rows if r[2] == "reporter"}
    # what is read after the lists is little more than what is found
    assert G.candidates(own, "reporter").count() < 1.5 * G.find(own, "reporter").count() + 5
    assert G.find(own, "nothing at all").count() == 0 == G.find(own, " ").count()
    gaps = own.lists.where(F.size("differences") != F.col("n")).count()
    assert gaps == 0 and own.lists.agg(F.max("n")).first()[0] <= 16
    assert G.find(G.index(df.limit(0), "name"), "abc").count() == 0


SAMPLES = [
    b"", b"plain", "日本é".encode(), E.BOM + b"with a mark", E.BOM, "第一行\n久期".encode("gb18030"), "a㐀b𠀀".encode("gb18030"), "hé".encode("latin-1"),
    "hé\n".encode("latin-1"), b"\xff\xfea\x00b\x00", b"\x81", b"\x81\x30\x81", b"\x81\x30\x81\x30", b"\x80abc", b"\xff", b"\xc3\x28", b"\xfe\xff\x00a"
]


@pytest.mark.parametrize("seed", range(2))
def test_texts_are_those_of_the_reader(spark, seed):
    rng = random.Random(seed)
    some = SAMPLES + [bytes(rng.choice(b"\x30\x39\x41\x7f\x80\x81\xfe\xffab\xc3\xa9") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(some)], "k int, content binary")
    got = {r["k"]: r["text"] for r in E.texts(df).collect()}
    assert got == {k: R.decode(x) for k, x in enumerate(some)}
    kinds = {r["k"]: r["kind"] for r in df.select("k", E.kind(F.col("content")).alias("kind")).collect()}
    for k, x in enumerate(some):
        try:
            x.decode("utf-8")
            assert kinds[k] == "utf-8"
        except UnicodeDecodeError:
            try:
                x.decode("gb18030")
                assert kinds[k] == "gb18030"
            except UnicodeDecodeError:
                pass


def test_utf8_stays_in_the_jvm(spark):
    plan = spark.createDataFrame([(b"x",)], "content binary").where(E.is_utf8(F.col("content"))).select(E.utf8_text(F.col("content")))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()


def test_content_of_any_size_is_decoded_in_pieces(spark, monkeypatch):
    """Python holds a few rows of a batch at once."""
    files = spark.createDataFrame([(k, ("é" * 50_000).encode("utf-16")) for k in range(60)], "k int, content binary").coalesce(1)
    frame = type(files)
    real = frame.mapInArrow

    def counted(self, run, fields):
        def sized(batches):
            for b in run(batches):
                yield b.set_column(b.schema.get_field_index("k"), "k", __import__("pyarrow").array([b.num_rows] * b.num_rows, "int32"))

        return real(self, sized, fields)

    monkeypatch.setattr(frame, "mapInArrow", counted)
    got = E.texts(files).select("k", F.length("text").alias("n")).collect()
    assert len(got) == 60 and {r["n"] for r in got} == {50_000} and max(r["k"] for r in got) <= 20
