"""Chat turns arriving as a stream: answered, emitted as events, remembered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from askorpus.functions import urls
from askorpus.plans.threads import ThreadStore
from askorpus.plans.turns import Engine, TurnResult, frames, run_turns


def stored_history(messages: DataFrame) -> DataFrame:
    """Message table in the shape the turn jobs read."""
    return messages.select(F.col("conversation_id").alias("thread_id"),
                           F.unix_micros("created_at").alias("pos"), "role", "content")


def message_id(part: Column) -> Column:
    """The id of a turn's question (part 0) or answer (part 1)."""
    return urls.uuid5(F.concat_ws("#", "turn_id", part.cast("string")))


def before_turns(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """The stored messages without those that these turns leave behind, so that a batch
    that is repeated sees its threads as it did the first time."""
    own = requests.select(F.explode(F.array(message_id(F.lit(0)), message_id(F.lit(1)))).alias("id"))
    return messages.join(own, "id", "left_anti")


def turn_messages(result: TurnResult, at: Column) -> DataFrame:
    """The question and the answer of each turn as a batch to append.

    Ids follow from the turn, so answering a turn again adds nothing. The answer
    is stamped a millisecond later to keep it behind its question.
    """
    rows = result.new_messages
    made, asked = message_id(F.col("part")), message_id(F.lit(0))
    return rows.select(
        made.alias("id"), F.col("thread_id").alias("conversation_id"),
        F.when(F.col("part") == 1, asked).alias("parent_id"), "role", "content",
        F.when(F.col("part") == 1, F.col("sources")).alias("sources"),
        (at + F.make_dt_interval(secs=F.col("part") / 1000)).alias("created_at"),
        F.col("part").alias("seq"))


def answer_stream(stream: DataFrame, engine: Engine, store: ThreadStore, events_path: str,
                  checkpoint: str, name: str = "turns", once: bool = False) -> StreamingQuery:
    """Answer each micro-batch of requests.

    Events of a batch go to their own folder, overwritten if the batch is
    repeated; messages are appended by id. Turns of one thread that should see
    each other belong in different batches.
    """
    def answer(batch: DataFrame, number: int) -> None:
        result = run_turns(batch, stored_history(before_turns(store.messages(), batch)), engine)
        frames(result.events).write.mode("overwrite").parquet(f"{events_path}/batch={number}")
        store.append(turn_messages(result, F.current_timestamp()), f"{name}-{number}")

    writer = stream.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).queryName(name).start()
