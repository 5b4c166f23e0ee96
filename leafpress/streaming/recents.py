"""Recents as keyed state: upsert by entry, ordered eviction, pins that never leave.

Each owner's list is one value of state, read and written once a batch, as each call between Python and the state's store
costs more than the list's own work. Rows of a batch are upserted (a newer one
counts, whatever the order in which they come), pins are remembered, and of the entries without a pin only the newest
``limit`` stay. What is evicted can't come back but by a newer row, as there are ``limit`` entries newer than it, so the
list is that of all rows so far. (A pin counts from the row that brings it: an entry that was evicted before comes back
with that row's time.) The state holds ``limit`` entries and the pinned ones, and survives restarts with
the stream's checkpoint (those of the map state of before can't be read: such a stream begins a new one).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leafpress import scratch
from leafpress.operators.activity import ACTIVITIES

#: State stores of the keyed API.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENTRY = "opened_at timestamp, entry_id bigint, pinned boolean"
#: An owner's list in its order, as one value: how often it was made, and its entries' columns.
STATE = "version bigint, entries array<string>, opened array<bigint>, numbers array<bigint>, pins array<boolean>"


class Recents(StatefulProcessor):
    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.list = handle.getValueState("list", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, own = 1, {}  # entry: (microseconds, number, pinned)
        if state := self.list.get():
            before, *columns = state
            n, own = before + 1, {e: (at, number, pin) for e, at, number, pin in zip(*columns, strict=True)}
        for part in rows:
            moments = part["opened_at"].to_numpy("datetime64[us]").astype("int64").tolist()
            for entry, at, number, pin in zip(part["entry"].tolist(), moments, part["entry_id"].tolist(), part["pinned"].tolist(), strict=True):
                new, old = (at, int(number), bool(pin)), own.get(entry)
                own[entry] = new if old is None else (*max(old[:2], new[:2]), old[2] or new[2])
        order = sorted(own, key=lambda e: (own[e][2], own[e][:2]), reverse=True)
        order = order[: sum(own[e][2] for e in order) + self.limit]  # pins come first
        at, number, pins = ([own[e][k] for e in order] for k in range(3))
        self.list.update((n, order, at, number, pins))
        yield pd.DataFrame(
            {
                "owner": [key[0]] * len(order), "version": [n] * len(order), "position": range(1, len(order) + 1), "entry": order,
                "opened_at": np.array(at, "datetime64[us]"), "entry_id": number, "pinned": pins
            }
        )

    def close(self) -> None:
        pass


def recents(rows: DataFrame, limit: int = ACTIVITIES) -> DataFrame:
    """A stream of (owner, entry, opened_at, entry_id, pinned) to each owner's list after each batch that has rows of theirs (update mode).

    ``version`` counts an owner's lists; the last one counts.
    """
    kind = rows.schema["owner"].dataType.simpleString()
    out = f"owner {kind}, version bigint, position bigint, entry string, {ENTRY}"
    return rows.groupBy("owner").transformWithStateInPandas(Recents(limit), out, "Update", "None")


def collected(stream: DataFrame, checkpoint: str, path: str, **trigger) -> DataFrame:
    """Runs a stream of ``recents`` over what is there, adds its lists to a table, and gives the last list of each owner."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def add(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure writes its own folder again
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
    query.awaitTermination()
    lists = spark.read.parquet(path).drop("batch")
    newest = lists.groupBy("owner").agg(F.max("version").alias("version"))
    return lists.join(newest, ["owner", "version"])


def last_lists(stream: DataFrame) -> DataFrame:
    """``collected`` with a checkpoint and a table of its own."""
    return collected(stream, scratch.new_path(stream.sparkSession), scratch.new_path(stream.sparkSession))
