"""Streams give what the batch jobs give, in however many batches they arrive."""

from pyspark.sql import functions as F

from askorpus.operators.ordering import last_n_per_key
from askorpus.plans import threads as th
from askorpus.sources.store import Store
from askorpus.streaming import history as sh
from askorpus.streaming.append import append_stream
from test_threads import BATCH, msg


def test_append_stream(spark, tmp_path):
    store = th.ThreadStore(Store(spark, str(tmp_path / "t"), th.TABLES))
    inbox = str(tmp_path / "in")
    rows = [[msg("t", "a", mid="1"), msg("u", "b", mid="2")], [msg("t", "again", mid="1"), msg("t", "c", seq=1, at=9)]]

    def go(checkpoint):
        stream = spark.readStream.schema(BATCH).option("maxFilesPerTrigger", 1).parquet(inbox)
        append_stream(stream, store, str(tmp_path / checkpoint), once=True).awaitTermination()

    for part in rows:
        spark.createDataFrame(part, BATCH).coalesce(1).write.mode("append").parquet(inbox)
        go("cp")
    assert sorted((r.conversation_id, r.content) for r in store.messages().collect()) == [
        ("t", "a"), ("t", "c"), ("u", "b")]
    # the same files once more, as after a lost checkpoint: batch numbers repeat, so do ids
    go("cp2")
    assert store.messages().count() == 3 and store.threads().count() == 2


def test_repeated_delivery_pushes_nothing_out():
    import pandas as pd

    class Kept(list):
        def get(self):
            return list(self)

        def put(self, rows):
            self[:] = rows

    memory = sh._LastMessages(6)
    memory.kept = Kept()
    rows = [(9, "m9", "user", "x")] * 6 + [(p, f"m{p}", "user", "x") for p in range(4, 9)]
    out = list(memory.handleInputRows(("t",), iter([pd.DataFrame(rows, columns=["pos", "id", "role", "content"])]), None))
    assert out[-1]["pos"].tolist() == [4, 5, 6, 7, 8, 9]


def test_history_state(spark, tmp_path):
    sh.use_state_store(spark)
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    # one busy thread with a third of everything, and replays of earlier messages
    rows = [("hot" if i % 3 == 0 else f"t{i % 20}", i, f"m{i}", "user", f"x{i}") for i in range(300)]
    every = spark.createDataFrame(rows, "thread_id string, pos long, id string, role string, content string")
    for part in (every.filter("pos < 150"), every.filter("pos >= 100"), every.filter("pos < 20")):
        part.coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        (sh.last_messages(stream, n=6, salts=4).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "cp")).option("path", out)
         .trigger(availableNow=True).start().awaitTermination())
    got = sh.merge_last(spark.read.parquet(out)).select(every.columns).collect()
    want = last_n_per_key(every, ["thread_id"], "pos", 6).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert spark.read.parquet(out).groupBy("thread_id").agg(F.count("*").alias("n")).count() == 21
