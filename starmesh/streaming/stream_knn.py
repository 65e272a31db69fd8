"""Nearest neighbours of arriving points in a static set, one micro-batch after another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from starmesh.operators.index import PointIndex, build_index
from starmesh.operators.neighbors import knn_pairs


def stream_knn(queries: DataFrame, source: DataFrame | PointIndex, k: int, out: str, checkpoint: str, boxsize: float | None = None) -> StreamingQuery:
    """Starts a query that writes the neighbours of each micro-batch of `queries` (a stream with id,
    x0, ...) to out/batch=N. A batch that is run again overwrites its own folder. The static set is sorted
    once, before the stream starts, or not at all if it is an index."""
    index = source if isinstance(source, PointIndex) else build_index(source)

    def one(batch: DataFrame, number: int) -> None:
        knn_pairs(index, k, query=batch, boxsize=boxsize).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
