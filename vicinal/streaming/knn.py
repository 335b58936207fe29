"""Neighbours of streamed points among static ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vicinal.operators.knn import knn_join


def stream_knn(stream: DataFrame, static: DataFrame, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str, metric: str = "euclidean") -> StreamingQuery:
    """Join each micro-batch of a stream of points (id, v) with ``static`` and hand the result to ``sink``."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: sink(knn_join(batch, static, k, metric), n)).start()
