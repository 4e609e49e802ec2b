"""An addition for streams: exposed rows that arrive are held against a fixed control table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import knn


def nearest_controls(stream: DataFrame, controls: DataFrame, id_col: str, metric, k: int, out_path: str, checkpoint: str, threshold: float = float("inf")) -> StreamingQuery:
    """Write the k nearest controls of every arriving row to ``out_path``, once for each micro-batch.

    A batch's rows go to a folder named after the batch, overwritten if the
    batch is repeated, so restarts neither lose nor double anything.
    """

    def one(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            if rows.limit(1).count():
                knn.top_k(rows, controls, id_col, metric, k, threshold).write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
