"""Per-thread memory as streaming state: the last messages of each thread."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from askorpus.operators.ordering import first_per_key, last_n_per_key

_STATE = "pos long, id string, role string, content string"
_OUT = f"thread_id string, {_STATE}"
SALTS = 16


class _LastMessages(StatefulProcessor):
    """Keeps the n highest positions of one (thread, salt), one row per id."""

    def __init__(self, n: int) -> None:
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {row[1]: tuple(row) for row in self.kept.get()}
        for part in rows:
            # a message delivered again must not take the place of another
            fresh = part.drop_duplicates("id").nlargest(self.n, "pos")
            for row in zip(fresh["pos"], fresh["id"], fresh["role"], fresh["content"]):
                held.setdefault(row[1], (int(row[0]),) + tuple(row[1:]))
            held = {r[1]: r for r in sorted(held.values())[-self.n:]}
        last = sorted(held.values())
        self.kept.put(last)
        out = pd.DataFrame(last, columns=["pos", "id", "role", "content"])
        out.insert(0, "thread_id", key[0])
        yield out

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Arbitrary state needs the RocksDB provider; set it before the query starts."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def last_messages(stream: DataFrame, n: int = 6, salts: int = SALTS) -> DataFrame:
    """Stream of what each updated (thread, salt) now holds.

    ``stream`` is (thread_id, pos, id, role, content). A busy thread is spread
    over ``salts`` keys by message id; each keeps n rows, and the last n of the
    thread are among them. ``merge_last`` puts them together.
    """
    salted = stream.select("thread_id", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"),
                           F.col("pos").cast("long"), "id", "role", "content")
    return salted.groupBy("thread_id", "salt").transformWithStateInPandas(
        statefulProcessor=_LastMessages(n), outputStructType=_OUT,
        outputMode="append", timeMode="none")


def merge_last(emitted: DataFrame, n: int = 6) -> DataFrame:
    """Last n messages per thread from everything the stream has emitted."""
    distinct = first_per_key(emitted, ["thread_id", "id"], ["pos"])
    return last_n_per_key(distinct, ["thread_id"], "pos", n)
