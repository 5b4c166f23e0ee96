"""Recents as state beside the same rows at once."""

import random

from pyspark.sql import functions as F

from leafpress.streaming import recents as S

SCHEMA = "owner long, entry string, opened_at timestamp, entry_id long, pinned boolean"


def lists(rows, limit):
    """Owner's entries as they are meant, by all rows."""
    out = {}
    for owner in {r[0] for r in rows}:
        newest, pins = {}, {r[1] for r in rows if r[0] == owner and r[4]}
        for _, entry, at, number, _ in (r for r in rows if r[0] == owner):
            newest[entry] = max(newest.get(entry, (at, number)), (at, number))
        free = sorted((e for e in newest if e not in pins), key=newest.get, reverse=True)[:limit]
        out[owner] = sorted(pins, key=newest.get, reverse=True) + free
    return out


def test_state_over_batches_and_a_restart(spark, tmp_path):
    rng, number, rows = random.Random(8), 0, []
    folder = tmp_path / "in"
    start = spark.sql("select timestamp'2024-01-01 00:00:00' t").first()[0]
    import datetime as dt

    def batch(k):
        nonlocal number
        own = []
        for _ in range(60):
            number += 1
            entry = f"e{rng.randint(0, 25)}"  # two of them are pinned whenever they come
            own.append((rng.randint(1, 4), entry, start + dt.timedelta(minutes=rng.randint(0, 500)), number, entry in ("e3", "e7")))
        rows.extend(own)
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.parquet(str(folder / f"b={k}"))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/b=*")
        got = S.collected(S.recents(stream, 5), str(tmp_path / "checkpoint"), str(tmp_path / "out"))
        out = {}
        for r in got.orderBy("owner", "position").collect():
            out.setdefault(r["owner"], []).append(r["entry"])
        return out

    for k in range(3):
        batch(k)
    assert run() == lists(rows, 5)
    for k in range(3, 5):  # the stream is started anew from its checkpoint
        batch(k)
    assert run() == lists(rows, 5)
    assert spark.read.parquet(str(tmp_path / "out")).select(F.max("batch")).first()[0] >= 4


def test_two_calls_of_state_a_batch():
    """However many rows and entries an owner has, a batch reads its state once and writes it once."""
    import pandas as pd

    class State:
        value, calls = None, 0

        def getValueState(self, *_):  # noqa: N802
            return self

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

    own, state = S.Recents(3), State()
    own.init(state)
    for n in range(1, 4):
        rows = pd.DataFrame(
            {"entry": [f"e{k % 9}" for k in range(40)], "opened_at": pd.to_datetime([60 * k + n for k in range(40)], unit="s"), "entry_id": range(40), "pinned": [k % 9 == 2 for k in range(40)]}
        )
        (got,) = own.handleInputRows((1,), iter([rows]), None)
        assert state.calls == 2 * n
        assert got["entry"].tolist() == ["e2", "e3", "e1", "e0"] and got["version"].tolist() == [n] * 4 and got["pinned"].tolist() == [True, False, False, False]
        assert got["opened_at"].tolist()[1] == pd.Timestamp(60 * 39 + n, unit="s")
