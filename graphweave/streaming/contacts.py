"""Contact counts over a stream; the counts commute, so the result equals the batch one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from graphweave.operators.contacts import canonical, edge_counts


def streaming_edges(contacts: DataFrame) -> DataFrame:
    return edge_counts(canonical(contacts))


def run_to_memory(contacts: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    return streaming_edges(contacts).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
