"""Starting a stream that takes in what is there and stops."""
from __future__ import annotations

from pyspark.sql import DataFrame


def run_to_end(frame: DataFrame, out_dir: str, checkpoint: str, state_partitions: int | None = None, conf: dict | None = None):
    """Write a stream to Parquet files until all input present now is taken in
    (``availableNow``); returns the ended query.

    Keyed state is split into ``state_partitions`` (default: the cluster's task slots).
    A new query fixes this number and the state store in its checkpoint, so both are
    set for the start only and put back."""
    spark = frame.sparkSession
    parts = state_partitions or spark.sparkContext.defaultParallelism
    wanted = {"spark.sql.shuffle.partitions": str(parts), **(conf or {})}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        q = (frame.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    q.awaitTermination()
    return q


def dropped_rows(query) -> int:
    """Rows that a query's stateful operators dropped as too late (after their map-side
    aggregation, where they have one)."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
