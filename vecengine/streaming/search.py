"""Searches for a stream of queries: each micro-batch is searched as a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.search import ivf_knn


def stream_knn(queries: DataFrame, members: DataFrame, centroids: DataFrame, k: int, nprobe: int, sink: Callable[[DataFrame, int], None], checkpoint: str, metric: str = "l2") -> StreamingQuery:
    """Start answering ``queries`` (a stream of ``(qid, qv)``); ``sink`` gets each batch's answers and its number.

    A batch that is tried again has the same number, so a sink that writes by number writes once.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(ivf_knn(batch, members, centroids, k, nprobe, metric), number)

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
