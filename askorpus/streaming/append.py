"""Messages arriving as a stream, appended so that a replay changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from askorpus.plans.threads import ThreadStore


def append_stream(stream: DataFrame, store: ThreadStore, checkpoint: str,
                  name: str = "append", once: bool = False) -> StreamingQuery:
    """Append every micro-batch. The stream has the message columns and ``seq``.

    Batches are named by number, so ids generated for a batch come out the same
    when Spark repeats it after a failure, and known ids are skipped.
    """
    def write(batch: DataFrame, number: int) -> None:
        store.append(batch, f"{name}-{number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).queryName(name).start()
