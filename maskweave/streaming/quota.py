"""A counter of requests as streaming state: it goes on where it stopped, and counts each log entry once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def count_requests(log: DataFrame, store: Store, checkpoint: str, client: str = "client_id", name: str = "quota") -> StreamingQuery:
    """Count a stream of log entries by client into a store's table (client, used), a version a batch; stops when all is counted.

    Counts are the stream's state under ``checkpoint``: after a stop or a failure they go on with the entries that came
    since. A batch that is run again, as its commit was lost, commits the same counts. Entries of no client count as
    their own.
    """

    def publish(counts: DataFrame, batch: int) -> None:
        store.update(lambda tables: {name: counts})

    counted = log.groupBy(F.col(client).alias("client")).agg(F.count("*").alias("used"))
    return counted.writeStream.outputMode("complete").foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
